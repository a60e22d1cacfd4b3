from tastemill.streaming.ledger import (  # noqa: F401
    run_to_table, stream_component_energy, stream_daily_timing, stream_feedback_weights,
)
