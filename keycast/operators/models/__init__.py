"""Forecast models. Each takes the fold frame and returns long prediction rows:
`group_id, model_name, fold, step, ds, actual, value, lower, upper`."""
