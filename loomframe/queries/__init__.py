"""Query catalogue: every module registers its queries on import."""

from importlib import import_module

MODULES = ("sources_q", "clean_q", "joins_q", "aggregate_q", "window_q", "scalar_q", "features_q", "text_q",
           "sampling_q", "state_q", "dedup_q", "web_q", "images_q", "metrics_q", "models_q", "streaming_q")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
