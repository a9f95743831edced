"""End-to-end plans: feature presets, preprocessing model, pipelines, query registry."""
