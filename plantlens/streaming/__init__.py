"""The drift state over a stream: EWMA and one-sided CUSUM carried from batch to batch for each series."""
