"""Market-surveillance and tip-risk scoring as DataFrame -> DataFrame functions on Spark."""
