"""The jobs: issue forecasts, evaluate them, replay the past."""
