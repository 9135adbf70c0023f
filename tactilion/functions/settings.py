"""Settings and the field registry: defaults, clamps and white lists as a table, JSON in and out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings as key, group, control, default, least, most or choices, saved with the document, affects braille.
FIELDS = (
    ("cells", "page", "number", "40", 10, 60, "", True, True), ("lines", "page", "number", "25", 10, 45, "", True, True), ("volumePages", "page", "number", "0", 0, 300, "", True, True),
    ("brailleCellW", "view", "number", "14", 8, 36, "", False, False), ("ttsRate", "speech", "decimal", "1", 0.5, 2.0, "", False, False), ("statusScale", "view", "decimal", "1", 0.6, 2.5, "", False, False),
    ("mode", "code", "choice", "ukaaf", None, None, "ukaaf bana", True, True), ("grade", "code", "choice", "g2", None, None, "g2 g1", True, True),
    ("mathCode", "code", "choice", "auto", None, None, "auto ueb nemeth", True, True), ("quoteStyle", "code", "choice", "faithful", None, None, "faithful exchange", True, True),
    ("listStyle", "layout", "choice", "spaced", None, None, "spaced compact", True, True), ("paragraphStyle", "layout", "choice", "indented", None, None, "indented block indented-spaced", True, True),
    ("tableFormat", "layout", "choice", "auto", None, None, "auto listed columnar vertical facing interchange stairstep linear", True, True),
    ("embosserDuplex", "device", "choice", "double", None, None, "double single", False, False), ("baudRate", "device", "choice", "9600", None, None, "9600 19200 38400 57600 115200", False, False),
    ("connectionType", "device", "choice", "serial", None, None, "serial hid ble network", False, False), ("networkPort", "device", "number", "9100", 1, 65535, "", False, False),
    ("tactileGraphics", "graphics", "on", "true", None, None, "", True, False), ("expertHardware", "device", "off", "false", None, None, "", False, False), ("sixKeyOn", "edit", "off", "false", None, None, "", False, False),
)
SCHEMA = "key string, grp string, control string, initial string, least double, most double, choices string, saved boolean, braille boolean"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, g, c, d, None if a is None else float(a), None if b is None else float(b), ch, s, br) for k, g, c, d, a, b, ch, s, br in FIELDS], SCHEMA)


def sanitized(settings: Column) -> Column:
    """``map<string,string>`` of all known settings: numbers clamped, choices and switches checked, others at their default."""
    out = []
    for key, _, control, initial, least, most, choices, _, _ in FIELDS:
        raw = F.try_element_at(settings, F.lit(key))
        if control in ("number", "decimal"):
            n = raw.try_cast("double")
            value = F.when(n.isNull() | F.isnan(n) | (n == 0) & (float(least) > 0), F.lit(float(initial))).otherwise(n)
            value = F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.floor(value + 0.5).cast("double") if control == "number" else value))
            made = value.cast("long").cast("string") if control == "number" else value.cast("string")
        elif control == "choice":
            made = F.when(raw.isin(*choices.split()), raw).otherwise(initial)
        else:
            made = F.when(F.coalesce(raw, F.lit("")) == ("false" if control == "on" else "true"), "false" if control == "on" else "true").otherwise(initial)
        out += [F.lit(key), made]
    return F.create_map(*out)


def from_json(text: Column) -> Column:
    """Settings of a JSON text, sanitised; malformed text gives the defaults."""
    return sanitized(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))


def to_json(settings: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(settings))))


def projection(spark: SparkSession, kind: str) -> DataFrame:
    """Parts of the registry: ``controls`` by key, ``groups`` with their keys in order, or what is ``saved`` with a document."""
    rows = registry(spark)
    if kind == "controls":
        return rows.select("key", "control", "initial", "choices")
    if kind == "saved":
        return rows.filter("saved").select("key", "braille")
    order = {k[0]: i for i, k in enumerate(FIELDS)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return rows.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col("key")).alias("at"), "key"))), lambda x: x["key"]).alias("keys"))


def presets(rows: DataFrame, standard: str) -> DataFrame:
    """Page sizes of the own standard first, then the others, by name."""
    return rows.orderBy(F.when(F.col("standard") == standard, 0).otherwise(1), "name")


def recent(codes: DataFrame, by: str, at: str, n: int = 5) -> DataFrame:
    """The last ``n`` different codes, newest first."""
    return codes.groupBy(by).agg(F.max(at).alias(at)).orderBy(F.desc(at), by).limit(n)


def date_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def defaults() -> str:
    return json.dumps({f[0]: f[3] for f in FIELDS}, sort_keys=True)
