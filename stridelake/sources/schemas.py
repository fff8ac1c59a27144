"""Declared table schemas and schema-on-read conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ── Fixed values: column names as devices report them ────────────────────────

SESSION_STRINGS = "source_file sport sub_sport sport_profile_name event event_type trigger".split()
SESSION_TIMES = "timestamp start_time".split()
SESSION_NUMBERS = """
total_elapsed_time total_timer_time total_moving_time total_distance avg_speed max_speed
enhanced_avg_speed enhanced_max_speed total_ascent total_descent total_fractional_ascent
total_fractional_descent avg_heart_rate max_heart_rate nec_lat nec_long swc_lat swc_long
start_position_lat start_position_long end_position_lat end_position_long num_laps
first_lap_index message_index event_group total_calories total_fat_calories
metabolic_calories total_strokes total_training_effect total_anaerobic_training_effect
training_load_peak avg_temperature max_temperature min_temperature avg_fractional_cadence
avg_flow avg_vam enhanced_avg_respiration_rate enhanced_max_respiration_rate
enhanced_min_respiration_rate
""".split()
SPORT_SESSION_NUMBERS = {
    "cycling": """
avg_power max_power normalized_power threshold_power total_work training_stress_score
intensity_factor avg_cadence max_cadence avg_cadence_position max_cadence_position
max_fractional_cadence left_right_balance avg_combined_pedal_smoothness
avg_left_pedal_smoothness avg_right_pedal_smoothness avg_left_torque_effectiveness
avg_right_torque_effectiveness avg_left_pco avg_right_pco max_power_position stand_count
time_standing total_grit total_cycles
""".split(),
    "running": """
training_stress_score intensity_factor avg_step_length total_strides avg_running_cadence
max_running_cadence avg_cadence max_cadence avg_stance_time avg_vertical_oscillation
avg_vertical_ratio
""".split(),
    "hiking": """
training_stress_score avg_step_length total_strides max_running_cadence avg_cadence max_cadence
""".split(),
    "climbing": "total_cycles total_grit".split(),
    "skiing": [],
}
RECORD_STRINGS = "source_file activity_type".split()
RECORD_TIMES = ["timestamp"]
RECORD_NUMBERS = """
distance speed enhanced_speed altitude enhanced_altitude heart_rate cadence
fractional_cadence temperature position_lat position_long
""".split()
SPORT_RECORD_NUMBERS = {
    "cycling": """
power accumulated_power compressed_accumulated_power left_pedal_smoothness
right_pedal_smoothness left_torque_effectiveness right_torque_effectiveness left_pco
right_pco combined_pedal_smoothness left_right_balance resistance cycles cycle_length16
vertical_oscillation vertical_ratio stance_time step_length enhanced_respiration_rate
flow grit
""".split(),
    "running": "vertical_oscillation vertical_ratio stance_time step_length cycles".split(),
    "hiking": "vertical_oscillation stance_time step_length cycles".split(),
}
SPLIT_STRINGS = "source_file split_type".split()
SPLIT_TIMES = "start_time end_time".split()
SPLIT_NUMBERS = """
message_index total_elapsed_time total_timer_time total_moving_time total_distance
total_ascent total_descent total_calories avg_speed max_speed avg_vert_speed
start_elevation start_position_lat start_position_long end_position_lat end_position_long
""".split()
SPLIT_SUMMARY_NUMBERS = """
message_index num_splits total_timer_time total_moving_time total_distance total_ascent
total_descent total_calories avg_speed max_speed avg_vert_speed avg_heart_rate max_heart_rate
""".split()
FILE_ID_COLUMNS = "garmin_product manufacturer number product serial_number time_created type".split()
ACTIVITY_COLUMNS = """
event event_group event_type local_timestamp num_sessions timestamp total_timer_time type
""".split()
SLEEP_STRINGS = "calendar_date sleep_start_gmt sleep_end_gmt feedback".split()
SLEEP_BIGINTS = """
deep_sec light_sec rem_sec awake_sec total_sleep_sec total_in_bed_sec awake_count restless_moments
""".split()
SLEEP_DOUBLES = """
sleep_efficiency_pct deep_hrs light_hrs rem_hrs awake_hrs total_sleep_hrs avg_spo2 avg_hr
avg_respiration lowest_respiration highest_respiration avg_sleep_stress
""".split()
SLEEP_INTS = """
lowest_spo2 score_overall score_quality score_duration score_recovery score_deep score_rem
""".split()
SPORT_VALUES = {
    "cycling": ["cycling"],
    "skiing": ["alpine_skiing"],
    "climbing": ["rock_climbing"],
    "running": ["running"],
    "hiking": ["hiking"],
}
RECORD_VIEW_COLUMNS = """
source_file timestamp power distance enhanced_altitude position_lat position_long
enhanced_speed cadence heart_rate
""".split()
RECORD_READ_COLUMNS = RECORD_VIEW_COLUMNS + ["sport", "sub_sport"]
MESSAGE_TYPES = """
file_id_mesgs activity_mesgs session_mesgs record_mesgs split_mesgs split_summary_mesgs
""".split()


def _struct(strings: list[str], times: list[str], numbers: list[str]) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in strings]
    fields += [T.StructField(c, T.TimestampNTZType()) for c in times]
    fields += [T.StructField(c, T.DoubleType()) for c in numbers]
    return T.StructType(fields)


def session_schema(sport: str) -> T.StructType:
    if sport not in SPORT_VALUES:
        raise ValueError(f"unknown sport {sport!r}; expected one of {sorted(SPORT_VALUES)}")
    return _struct(SESSION_STRINGS, SESSION_TIMES, SESSION_NUMBERS + SPORT_SESSION_NUMBERS[sport])


def record_schema(sport: str) -> T.StructType:
    """A sport without its own record columns uses the shared ones."""
    return _struct(RECORD_STRINGS, RECORD_TIMES, RECORD_NUMBERS + SPORT_RECORD_NUMBERS.get(sport, []))


SPLIT_SCHEMA = _struct(SPLIT_STRINGS, SPLIT_TIMES, SPLIT_NUMBERS)
SPLIT_SUMMARY_SCHEMA = _struct(SPLIT_STRINGS, [], SPLIT_SUMMARY_NUMBERS)
SLEEP_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in SLEEP_STRINGS]
    + [T.StructField(c, T.LongType()) for c in SLEEP_BIGINTS]
    + [T.StructField(c, T.DoubleType()) for c in SLEEP_DOUBLES]
    + [T.StructField(c, T.IntegerType()) for c in SLEEP_INTS]
)
REQUIRED_SESSION = _struct(["sport"], ["timestamp"], ["total_timer_time"])


def _merge(schemas: list[T.StructType]) -> T.StructType:
    seen: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            seen.setdefault(field.name, field)
    return T.StructType([seen[n] for n in sorted(seen)])


def ingest_schema(msg_type: str) -> T.StructType:
    """Union of every sport's columns for a message type; what a written row is padded to."""
    if msg_type == "session_mesgs":
        return _merge([session_schema(s) for s in SPORT_VALUES])
    if msg_type == "record_mesgs":
        return _merge([record_schema(s) for s in SPORT_VALUES])
    if msg_type == "split_mesgs":
        return _merge([SPLIT_SCHEMA])
    if msg_type == "split_summary_mesgs":
        return _merge([SPLIT_SUMMARY_SCHEMA])
    if msg_type == "file_id_mesgs":
        numbers, times = ["number", "product", "serial_number"], ["time_created"]
        return _struct(["source_file"] + [c for c in FILE_ID_COLUMNS if c not in numbers + times], times, numbers)
    if msg_type == "activity_mesgs":
        times = ["local_timestamp", "timestamp"]
        numbers = ["event_group", "num_sessions", "total_timer_time"]
        strings = [c for c in ACTIVITY_COLUMNS if c not in times + numbers]
        return _struct(["source_file"] + strings, times, numbers)
    raise ValueError(f"unknown message type {msg_type!r}")


def lenient_cast(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return column
    if isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if isinstance(want, T.TimestampNTZType) and isinstance(have, (T.TimestampType, T.DateType)):
        return column.cast(want)
    if isinstance(want, (T.LongType, T.IntegerType)) and isinstance(have, T.StringType):
        return column.try_cast("double").try_cast(want)
    return column.try_cast(want)


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = True) -> DataFrame:
    """Every declared column present with its declared type: missing → null, bad value → null.

    One projection, so Catalyst still prunes what the caller does not use.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    declared = [
        (lenient_cast(F.col(f.name), have[f.name], f.dataType) if f.name in have
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    names = {f.name for f in schema.fields}
    extra = [F.col(c) for c in df.columns if c not in names] if keep_extra else []
    return df.select(*extra, *declared)
