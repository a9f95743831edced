"""One fitted preprocessing model for a flow table (P, A, J operators in order).

fit:  drop -> bool text -> category/label fill -> numeric coercion ->
      (optional) drop all-NULL features -> median imputer -> one-hot ->
      label encoder -> scaler.  Each statistic is fitted on an explicit
      frame: ``fit_frame`` (default: the train frame) for imputer, one-hot
      and label encoder; the scaler always on train.
transform: the same projections with fitted values inlined; the output
      has (key, y, feature columns...) plus the list ``feature_names``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.functions.text import c
from floe.operators.columns import (coerce_numeric, common_columns, drop_columns, feature_columns,
                                    fill_categories, map_bool_columns, non_empty_columns)
from floe.operators.fitted import (LabelEncoder, LabelEncoderModel, MedianImputer, MedianImputerModel,
                                   OneHotEncoder, OneHotModel, StandardScaler, StandardScalerModel)


def clean(df: DataFrame, drop: list[str], bools: list[str], categories: list[str], label: str,
          numeric: list[str]) -> DataFrame:
    """P1, P4, P6/P7, P5/P3 in one chain of projections."""
    out = drop_columns(df, drop)
    out = map_bool_columns(out, bools)
    out = fill_categories(out, [*categories, label])
    return coerce_numeric(out, numeric)


@dataclass
class PreprocessModel:
    key: str
    label: str
    drop: list[str]
    bools: list[str]
    categories: list[str]
    numeric: list[str]
    imputer: MedianImputerModel
    onehot: OneHotModel
    labels: LabelEncoderModel
    scaler: StandardScalerModel | None
    sparse: bool = False        # categories stay text columns beside the features

    @property
    def feature_names(self) -> list[str]:
        nums = [n for n in self.numeric if n not in self.imputer.dropped]
        return nums + self.onehot.output_names()

    def fit_scaler(self, unscaled: DataFrame) -> None:
        """Fit the scaler on the train rows' unscaled features."""
        self.scaler = StandardScaler(self.feature_names).fit(unscaled)

    def transform(self, df: DataFrame, scale: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
        """Features (and label code ``y``) with fitted values inlined; ``keep`` names columns to pass through.

        Frames without the label column (unlabelled flows to score) get a
        NULL ``y``.
        """
        if self.label not in df.columns:
            df = df.withColumn(self.label, F.lit(None).cast("string"))
            labelled = False
        else:
            labelled = True
        cleaned = clean(df, self.drop, self.bools, self.categories, self.label, self.numeric)
        if not labelled:   # clean() filled the NULL label; undo for unlabelled frames
            cleaned = cleaned.withColumn(self.label, F.lit(None).cast("string"))
        imputed = self.imputer.transform(cleaned.select(c(self.key), c(self.label), *[c(n) for n in keep],
                                                        *[c(n) for n in [*self.numeric, *self.categories]]))
        coded = (self.labels.transform(imputed) if labelled
                 else imputed.withColumn(self.labels.output_col, F.lit(None).cast("int")))
        wide = coded.select(c(self.key), F.col(self.labels.output_col).alias("y"), *[c(n) for n in keep],
                            *[c(n) for n in self.numeric if n not in self.imputer.dropped],
                            *self.onehot.columns(), *[c(n) for n in (self.categories if self.sparse else [])])
        if scale and self.scaler is not None:
            wide = self.scaler.transform(wide)
        return wide


class Preprocess:
    def __init__(self, key: str, label: str, drop=(), bools=(), categories=(),
                 drop_empty: bool = False, impute: str = "exact", sparse: bool = False):
        self.key, self.label = key, label
        self.drop, self.bools, self.categories = list(drop), list(bools), list(categories)
        self.drop_empty = drop_empty
        self.impute = impute
        self.sparse = sparse

    def fit(self, train: DataFrame, fit_frame: DataFrame | None = None,
            test: DataFrame | None = None, scale: bool = True) -> PreprocessModel:
        """Fit on ``train``; ``fit_frame`` (e.g. all rows) overrides the frame for
        imputer, one-hot and label encoder.  With ``test`` given, categories are
        limited to those present in both frames (P8).  ``scale=False`` leaves the scaler to
        ``fit_scaler``."""
        frames = [train] + ([test] if test is not None else [])
        cats = common_columns(self.categories, *frames)
        base = map_bool_columns(drop_columns(train, self.drop), self.bools)
        # a category absent from one frame is not a category; it stays a feature
        numeric = feature_columns(base, self.label, cats, [self.key])
        if self.drop_empty:
            numeric = non_empty_columns(base, numeric)
        source = fit_frame if fit_frame is not None else train
        cleaned = clean(source, self.drop, self.bools, cats, self.label, numeric)
        imputer = MedianImputer(numeric, self.impute).fit(cleaned)
        onehot = OneHotEncoder([] if self.sparse else cats).fit(cleaned)
        labels = LabelEncoder(self.label, "_floe_y").fit(cleaned)
        model = PreprocessModel(self.key, self.label, self.drop, self.bools, cats, numeric, imputer, onehot,
                                labels, None, self.sparse)
        if scale:
            model.fit_scaler(model.transform(train, scale=False))
        return model
