"""Names: slugs, header and tag parsing, tag types and categories, plant lookup.

All are column expressions evaluated by the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantspark.schema import any_of

# Tag type by the first rule whose substring occurs; order matters.
TAG_TYPE_RULES = (
    ("TEMPERATURE", ("TI", "TE", "TEMP")),
    ("PRESSURE", ("PI", "PE", "PRESS")),
    ("FLOW", ("FI", "FE", "FLOW")),
    ("LEVEL", ("LI", "LE", "LEVEL")),
    ("SPEED", ("SI", "SPEED", "RPM")),
    ("VIBRATION", ("XI", "VIBR", "VIB")),
    ("POSITION", ("ZI", "VALVE", "POS")),
    ("PERFORMANCE", ("PERFORMANCE",)),
)

# Indicator wording by the code inside the tag, first hit wins.
INDICATOR_RULES = (
    ("TI", "Temperature Indicator", "Process temperature measurement"),
    ("PI", "Pressure Indicator", "Process pressure measurement"),
    ("LI", "Level Indicator", "Process level measurement"),
    ("FI", "Flow Indicator", "Process flow measurement"),
    ("SI", "Speed Indicator", "Rotational speed measurement"),
    ("XI", "Vibration Indicator", "Mechanical vibration measurement"),
    ("ZI", "Position Indicator", "Valve/actuator position"),
    ("PY", "Pressure Controller", "Process pressure control output"),
    ("PV", "Process Variable", "General process measurement"),
)

# Category patterns on the lower-case tag; a tag may have several.
CATEGORY_PATTERNS = (
    ("flow_indicator", r"fi[-_]?\d+"),
    ("temperature", r"ti[ac]?[-_]?\d+"),
    ("pressure", r"pi[-_]?\d+"),
    ("level", r"li[ac]?[-_]?\d+"),
    ("control_valve", r"[fl]v[-_]?\d+|mv"),
    ("motor_drive", r"motor|drive|speed|rpm"),
    ("flow_control", r"f[hic]+[-_]?\d+"),
    ("analyzer", r"xia[-_]?\d+"),
    ("differential_pressure", r"pdia|dpia"),
    ("performance", r"margin|performance"),
)

# Words that make a tag a pure speed tag (the longer published patterns,
# such as motor + speed or rate + rpm, all contain one of these words).
PURE_SPEED_WORDS = ("speed", "rpm", "freq", "hz", "rps", "vfd", "rotation", "velocity")

# The broad keyword list of the wide scan.
BROAD_SPEED_WORDS = (
    "speed", "rpm", "velocity", "rate", "flow", "freq", "frequency",
    "hz", "rps", "rotation", "spin", "motor", "drive", "pump",
    "compressor", "turbine", "fan", "agitator", "mixer", "stirrer",
)

# Speed sensor name parts, and name parts that rule a tag out.
SPEED_SENSOR_PARTS = ("SI", "SIA", "SPEED", "RPM", "SE")
NOT_SPEED_PARTS = ("TEMP", "PRESS", "FLOW", "LEVEL", "VIB")
RUNNING_SENSOR_PARTS = ("SI", "SIA", "SPEED", "RPM", "FI", "FLOW")

# Units of each plant.
PLANT_UNITS = {
    "PCFS": ("K-12-01", "K-16-01", "K-19-01", "K-31-01"),
    "PCMSB": ("C-02001", "C-104", "C-13001", "C-1301", "C-1302", "C-201", "C-202", "XT-07002"),
    "ABFSB": ("07-MT01-K001",),
}
PLANT_PREFIXES = (("K-", "PCFS"), ("C-", "PCMSB"))

HEADER = r"^([A-Za-z0-9_\-]+)\s+([A-Za-z]+-\d{2}(?:-\d{2})?)\s+(.+)$"
HEADER_UNIT = r"\b([A-Z]+-\d{2}(?:-\d{2})?)\b"


def slug(text: Column) -> Column:
    """The internal spelling: blanks and any other character become ``_``, ``-`` stays."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "_"), r"[^A-Za-z0-9_\-]", "_")


def slug_lower(text: Column) -> Column:
    """Import spelling: lower case with ``.`` and ``-`` as ``_``."""
    return F.translate(F.lower(text), ".-", "__")


def slug_dots(text: Column) -> Column:
    """Import spelling that only replaces dots."""
    return F.translate(text, ".", "_")


def header_parts(header: Column) -> Column:
    """``<plant> <unit> <tag>`` as a struct; otherwise plant null and the unit by pattern."""
    text = F.trim(header)
    full = text.rlike(HEADER)
    loose = F.regexp_extract(F.upper(text), HEADER_UNIT, 1)
    return F.struct(
        F.when(full, F.regexp_extract(text, HEADER, 1)).alias("plant"),
        F.when(full, F.regexp_extract(text, HEADER, 2)).otherwise(F.nullif(loose, F.lit(""))).alias("unit"),
        F.when(full, F.trim(F.regexp_extract(text, HEADER, 3))).otherwise(text).alias("tag"),
    )


def tag_parts(tag: Column) -> Column:
    """``plant_unit_id[_suffix]`` as a struct; fewer than three parts keep the whole tag as id."""
    parts = F.split(tag, "_")
    long = F.size(parts) >= 3
    return F.struct(
        F.when(long, F.element_at(parts, 1)).otherwise("Unknown").alias("plant"),
        F.when(long, F.try_element_at(parts, F.lit(2))).otherwise("Unknown").alias("unit"),
        F.when(long, F.try_element_at(parts, F.lit(3))).otherwise(tag).alias("tag_id"),
        F.when(long, F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("PV"))).otherwise("PV").alias("suffix"),
    )


def tag_type(tag: Column) -> Column:
    upper, out = F.upper(tag), F.lit("UNKNOWN")
    for name, needles in reversed(TAG_TYPE_RULES):
        out = F.when(any_of(upper, needles), name).otherwise(out)
    return out


def indicator(tag: Column) -> Column:
    """Indicator wording: the code part decides, PERFORMANCE in the whole tag comes last."""
    code = tag_parts(tag)["tag_id"]
    performance = F.upper(tag).contains("PERFORMANCE")
    kind = F.when(performance, "Performance Calculation").otherwise("Unknown")
    text = F.when(performance, "Equipment performance metric").otherwise("Unclassified measurement")
    for needle, name, description in reversed(INDICATOR_RULES):
        kind = F.when(code.contains(needle), name).otherwise(kind)
        text = F.when(code.contains(needle), description).otherwise(text)
    return F.struct(kind.alias("tag_type"), text.alias("description"))


def categories(tag: Column) -> Column:
    lower = F.lower(tag)
    found = F.array_compact(F.array(*[F.when(lower.rlike(p), F.lit(n)) for n, p in CATEGORY_PATTERNS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def is_pure_speed(tag: Column) -> Column:
    return any_of(F.lower(tag), PURE_SPEED_WORDS)


def is_broad_speed(tag: Column) -> Column:
    return any_of(F.lower(tag), BROAD_SPEED_WORDS)


def is_speed_sensor(tag: Column) -> Column:
    upper = F.upper(tag)
    return any_of(upper, SPEED_SENSOR_PARTS) & ~any_of(upper, NOT_SPEED_PARTS)


def is_running_sensor(tag: Column) -> Column:
    return any_of(F.upper(tag), RUNNING_SENSOR_PARTS)


def plant_of_unit(unit: Column) -> Column:
    """Plant by listed unit (which overrides naming), else by prefix, else UNKNOWN."""
    out = F.lit("UNKNOWN")
    for prefix, plant in reversed(PLANT_PREFIXES):
        out = F.when(unit.startswith(prefix), plant).otherwise(out)
    for plant, units in PLANT_UNITS.items():
        out = F.when(unit.isin(*units), plant).otherwise(out)
    return out


def speed_kind(tag: Column, highest: Column) -> Column:
    """Kind, likely unit and machine class of a speed tag from its name and maximum."""
    lower = F.lower(tag)
    rpm_or_hz = F.when(highest > 100, "RPM").otherwise("Hz")
    motor = lower.contains("rpm") | (lower.contains("motor") & (highest > 100))
    drive = lower.contains("freq") | lower.contains("hz")
    pump, turbine, compressor = (lower.contains(w) for w in ("pump", "turbine", "compressor"))
    return F.struct(
        F.when(motor, "motor_rpm").when(drive, "drive_frequency").when(pump, "pump_speed")
        .when(turbine, "turbine_speed").when(compressor, "compressor_speed").otherwise("unknown").alias("speed_type"),
        F.when(motor, "RPM").when(drive, "Hz").when(pump, rpm_or_hz)
        .when(turbine, "RPM").when(compressor, rpm_or_hz).otherwise("unknown").alias("units_likely"),
        F.when(motor, F.when(highest > 1000, "high_speed_motor").otherwise("low_speed_motor"))
        .when(drive, F.when(highest <= 100, "variable_frequency_drive").otherwise("high_frequency_drive")).alias("machine_class"),
    )
