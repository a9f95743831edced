"""Feature-set presets of the two flow datasets (configuration, not operators)."""

from __future__ import annotations

# Identifiers, timestamps and the binary label of the WUSTL flows.
WUSTL_ALWAYS_DROP = ["Timestamp", "LastTime", "SrcIP", "DstIP", "Target", "sIpId", "dIpId"]

# Numeric WUSTL columns removed in the reduced feature set.
WUSTL_REDUCED_DROP = [
    "DIntPkt", "TotalBytes", "DstRate", "Loss", "Protocol", "DstJitAct", "TotAppByte", "TcpRtt",
    "SynAck", "IdleTime", "TotalPkts", "SrcPkts", "SrcBytes", "Duration", "DstLoad", "sDSb", "sTos",
    "DstPkts", "DstJitter", "SrcJitAct", "Sum", "RunTime", "Max", "Min", "Mean", "SIntPkt",
    "SrcJitter", "SAppBytes",
]

WUSTL_LABEL = "Traffic"

# Always dropped X-IIoTID columns.
X_ALWAYS_DROP = ["Date", "Timestamp", "SrcIP", "DstIP", "class1", "class3"]

# X-IIoTID columns removed in the reduced feature set.  One
# entry holds two names in a single string; it is kept as written (it then
# matches no column) unless ``split_joined_names`` is set.
X_REDUCED_DROP = [
    "Std_nice_time", "DstPkts", "Scr_ip_bytes", "TotalPkts, Std_ldavg_1", "Std_kbmemused", "SrcPkts",
    "Std_wtps", "Avg_iowait_time", "Std_iowait_time", "missed_bytes", "Avg_num_Proc/s", "Std_num_proc/s",
    "Std_user_time", "Avg_kbmemused", "byte_rate", "Std_rtps", "Std_tps", "PktRate", "Des_ip_bytes",
    "Avg_wtps", "SrcBytes", "Avg_tps", "SrcPort", "Duration", "TotalBytes", "DstBytes", "Avg_rtps",
    "Std_ideal_time",
]

# X-IIoTID text boolean columns, categories and label.
X_BOOL_COLUMNS = ["is_syn_only", "Is_SYN_ACK", "is_pure_ack", "is_with_payload", "FIN or RST",
                  "Bad_checksum", "is_SYN_with_RST", "anomaly_alert"]
X_CATEGORIES = ["Protocol", "Service", "Conn_state"]
X_LABEL = "class2"


def _split_names(cols: list[str]) -> list[str]:
    out = []
    for n in cols:
        out.extend([p.strip() for p in n.split(",")] if "," in n else [n])
    return out


def preset(name: str, split_joined_names: bool = False) -> dict:
    """Columns to drop, bool columns, categories and label of a preset."""
    if name == "wustl_full":
        spec = dict(drop=WUSTL_ALWAYS_DROP, bools=[], categories=[], label=WUSTL_LABEL)
    elif name == "wustl_reduced":
        spec = dict(drop=WUSTL_ALWAYS_DROP + WUSTL_REDUCED_DROP, bools=[], categories=[], label=WUSTL_LABEL)
    elif name == "x_full":
        spec = dict(drop=X_ALWAYS_DROP, bools=X_BOOL_COLUMNS, categories=X_CATEGORIES, label=X_LABEL)
    elif name == "x_reduced":
        drop = X_ALWAYS_DROP + X_REDUCED_DROP
        spec = dict(drop=_split_names(drop) if split_joined_names else drop, bools=X_BOOL_COLUMNS,
                    categories=X_CATEGORIES, label=X_LABEL)
    else:
        raise ValueError(f"unknown preset {name!r}")
    return {k: list(v) if isinstance(v, list) else v for k, v in spec.items()}
