from tidemark.functions.names import (  # noqa: F401
    connector_name,
    dead_letter_topic,
    lakehouse_connector_name,
    map_topic,
    route_topic,
    split_target,
    subject_name,
    table_name,
)
from tidemark.functions.tiers import (  # noqa: F401
    TIERS,
    effective_settings,
    tier_or_default,
    tier_value,
    with_thresholds,
    with_tier,
)
from tidemark.functions.units import (  # noqa: F401
    bytes_to_megabytes,
    duration_text,
    millis_to_seconds,
    nanos_to_millis,
    per_minute,
    ratio_percent,
    years_to_millis,
)
