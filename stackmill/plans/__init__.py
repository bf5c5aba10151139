"""Multi-job plans: model fits, banks of fits, stacking, search, end-to-end training and scoring."""
