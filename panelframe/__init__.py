"""Panel analytics on PySpark. Public names are loaded when first used, so that executors which need one module load only that."""

from importlib import import_module

_HOMES = {
    "sources.panel": ["Domain", "Panel", "CategoryPanel", "PredictionPanel", "PanelError", "align_frames"],
    "plans.graph": ["Graph", "GraphSpec", "GraphValidationError", "CompiledGraph", "Runtime"],
    "operators.registry": ["TRANSFORMERS", "COMPOSERS", "PREDICTIONS", "Contract", "custom_transformer", "custom_composer"],
    "operators.builtin": ["pct_change_frame"],
    "operators.prediction": [
        "PredictionComposer", "Identity", "EqualWeight", "ICWeighted", "ICWeightedDecay", "QuantileICWeighted", "OLS", "GLS", "fama_macbeth_ols",
        "quantile_rank_information_coefficient",
    ],
    "functions.learning": [
        "WalkForwardConfig", "WalkForwardFold", "expanding_walk_forward", "LabelBoundary", "equal_period_weights", "RmsScaler", "Gram", "alpha_max", "candidates",
        "ElasticNetSearchMode", "ElasticNetConfig", "ElasticNetCandidate", "ElasticNet", "ElasticNetPredictionComposer",
    ],
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    if _HOME[name].startswith("operators."):
        import_module(".operators.builtin", __name__)  # registers the operators
    return getattr(import_module(f".{_HOME[name]}", __name__), name)
