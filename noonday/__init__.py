"""Fleet analytics for therapy-device telemetry, as Spark DataFrame functions keyed by ``card_id``."""
