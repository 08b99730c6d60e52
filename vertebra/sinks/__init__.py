"""Set-wise, idempotent writers (Spark task retries replace the reference's retry loops)."""
