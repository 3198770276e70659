"""File sources and sinks, rule configurations and model artifacts."""
