"""Column-level functions: parsing, names, fingerprints, decisions.

Everything here is a Catalyst expression; the one exception is IPv6 text, which only
the rows that hold a ':' send through an Arrow batch.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from flowsift.schema import CLASSES, EPSILON, SEVERITY_BANDS, UNKNOWN_ANOMALY


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _is_finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


# white space that trimming removes
BLANKS = " \t\n\r\x0b\x0c"


def _strip(value) -> Column:
    return F.btrim(_col(value).cast("string"), F.lit(BLANKS))


def text(value) -> Column:
    """Trimmed text; null, blank and '-' become ''."""
    trimmed = _strip(value)
    return F.coalesce(F.when(trimmed != "-", trimmed), F.lit(""))


def number(value) -> Column:
    """Finite double or null."""
    parsed = _strip(value).try_cast("double")
    return F.when(_is_finite(parsed), parsed)


def number_or(value, default: float = 0.0) -> Column:
    return F.coalesce(number(value), F.lit(default))


def count_value(value) -> Column:
    """Non-negative whole number, '-' is zero, anything else null."""
    raw = _strip(value)
    exact = raw.try_cast("bigint")
    parsed = number(raw)
    whole = F.when(parsed == F.floor(parsed), parsed.try_cast("bigint"))
    # plain digits stay exact beyond 2**53, where a double would not
    result = F.coalesce(F.when(raw.rlike(r"^[+-]?\d+$"), exact), whole)
    return F.when(raw == "-", F.lit(0).cast("bigint")).when(result >= 0, result)


_WHOLE_TYPES = ("byte", "short", "integer", "long")
_REAL_TYPES = ("float", "double", "decimal")


def number_of(df: DataFrame, name: str) -> Column:
    """number() of a column; numeric columns skip the way through text."""
    kind, value = df.schema[name].dataType.typeName(), F.col(name)
    if kind in _WHOLE_TYPES:
        return value.cast("double")
    if kind in _REAL_TYPES:
        wide = value.cast("double")
        # what is not finite less itself is no number; short, since model rows hold dozens of these in one method
        return F.when(wide - wide == 0, wide)
    return number(value)


def count_of(df: DataFrame, name: str) -> Column:
    """count_value() of a column; numeric columns skip the way through text."""
    kind, value = df.schema[name].dataType.typeName(), F.col(name)
    if kind in _WHOLE_TYPES:
        return F.when(value >= 0, value.cast("bigint"))
    if kind in _REAL_TYPES:
        return F.when((value >= 0) & (value == F.floor(value)), value.try_cast("bigint"))
    return count_value(value)


def required(value: Column, message: str) -> Column:
    """The value, or an error that ends the job (strict mode)."""
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def safe_divide(numerator, denominator) -> Column:
    top, bottom = _col(numerator).cast("double"), _col(denominator).cast("double")
    ratio = F.when(F.abs(bottom) >= EPSILON, top / bottom)
    return F.when(_is_finite(ratio), ratio).otherwise(F.lit(0.0))


def ticks(ts) -> Column:
    """Epoch seconds as whole microseconds, the resolution of the logs."""
    return F.floor(_col(ts).cast("double") * 1_000_000 + 0.5)


def event_time(ts) -> Column:
    return F.timestamp_micros(ticks(ts))


def iso_utc(ts) -> Column:
    """ISO-8601 text of an epoch, in UTC whatever the session's zone is."""
    micros = ticks(ts)
    seconds = F.floor(micros / F.lit(1_000_000)).cast("decimal(18,6)")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    fraction = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(F.translate(moment.cast("string"), " ", "T"), F.lit("."), fraction, F.lit("+00:00"))


def timestamp_seconds(ts) -> Column:
    """A timestamp column as epoch seconds."""
    return F.unix_micros(_col(ts)) / F.lit(1_000_000.0)


@F.pandas_udf(StringType())
def _canonical_ipv6(addresses: pd.Series) -> pd.Series:
    def clean(address):
        if address is None:
            return None
        try:
            return str(ipaddress.ip_address(address))
        except ValueError:
            return address

    return addresses.map(clean)


def clean_ip(value) -> Column:
    """Canonical address; unparseable text stays as it is, blank and '-' become ''.

    A valid IPv4 text is its own canonical form, so only IPv6 is parsed; other rows pass the
    Python stage as nulls. Logs known to hold no IPv6 can use clean_ipv4 and skip that stage.
    """
    raw = _col(value).cast("string")
    blank = raw.isNull() | _strip(raw).isin("", "-")
    return F.when(blank, F.lit("")).otherwise(
        F.coalesce(_canonical_ipv6(F.when(raw.contains(":"), raw)), raw)
    )


def clean_ipv4(value) -> Column:
    """clean_ip for inputs known to hold no IPv6 text: stays inside the JVM."""
    raw = _col(value).cast("string")
    return F.when(raw.isNull() | _strip(raw).isin("", "-"), F.lit("")).otherwise(raw)


def truthy(value) -> Column:
    """Boolean normalisation of flags written as text, numbers or booleans."""
    raw = F.lower(text(value))
    return raw.isin("1", "true", "t", "yes", "y", "on")


def truthy_number(value) -> Column:
    parsed = _col(value).cast("double")
    return F.coalesce(_is_finite(parsed) & (parsed != 0), F.lit(False))


def char_entropy(value) -> Column:
    """Shannon entropy in bits of the characters of a text.

    The sorted characters form one run per distinct character, so only the runs, not the
    characters, go through a fold. Cost is n log n in the length of the text.
    """
    raw = _col(value)
    ordered = F.array_join(F.sort_array(F.split(raw, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))

    def add(total: Column, run: Column) -> Column:
        count = F.length(run).cast("double")
        return total + F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))

    size = F.length(raw).cast("double")
    entropy = F.log2(size) - F.aggregate(runs, F.lit(0.0), add) / size
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.greatest(entropy, F.lit(0.0)))


def label_count(value) -> Column:
    """Number of non-empty dot-separated labels of a name."""
    return F.size(F.filter(F.split(text(value), r"\."), lambda part: part != ""))


def dns_qtype(value) -> Column:
    """Record-type name; the four numeric codes that matter are named, others stay."""
    upper = F.upper(text(value))
    code = number(upper)
    named = (
        F.when(code == 1, "A").when(code == 28, "AAAA").when(code == 16, "TXT").when(code == 15, "MX")
    )
    return F.coalesce(named, upper)


# fixed values: TLS minor version -> ordinal
TLS_ORDINALS = {"0": 1, "1": 2, "2": 3, "3": 4}


def tls_ordinal(value) -> Column:
    """1..4 for TLS 1.0..1.3 in any of the spellings TLS1.2, TLSv1.2, TLSv12, TLS12; else 0."""
    compact = F.translate(F.upper(text(value)), " _", "")
    minor = F.regexp_extract(compact, r"^TLSV?1\.?([0-3])$", 1)
    return F.coalesce(minor.try_cast("int") + 1, F.lit(0))


def packet_sizes(value) -> Column:
    """Non-negative sizes of a '[1,2,3]' style text as array<double>."""
    raw = F.regexp_replace(text(value), r"^[\[\]{}]+|[\[\]{}]+$", "")
    sizes = F.transform(F.split(raw, ","), lambda part: number(part))
    return F.filter(sizes, lambda size: size >= 0)


def severity(confidence) -> Column:
    value = _col(confidence)
    chain = F.when(value >= SEVERITY_BANDS[0][1], SEVERITY_BANDS[0][0])
    for name, floor in SEVERITY_BANDS[1:]:
        chain = chain.when(value >= floor, name)
    return chain.otherwise("info")


def severity_rank(value) -> Column:
    """critical 4 > high 3 > medium 2 > anything else 1."""
    name = _col(value)
    return F.when(name == "critical", 4).when(name == "high", 3).when(name == "medium", 2).otherwise(1)


def severity_name(rank) -> Column:
    value = _col(rank)
    return F.when(value == 4, "critical").when(value == 3, "high").when(value == 2, "medium").otherwise("info")


def anomaly_norm(raw_score) -> Column:
    """Isolation score over 0.8, clipped to 0..1."""
    return F.least(F.greatest(_col(raw_score) / 0.8, F.lit(0.0)), F.lit(1.0))


def class_name(index, classes=CLASSES) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), _col(index).cast("int") + 1)


def class_index(name, classes=CLASSES) -> Column:
    """Alphabetical class index, null for an unknown name."""
    position = F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), _col(name))
    return F.when(position > 0, (position - 1).cast("int"))


def decide(probabilities, anomaly, classes=CLASSES, policy: str = "service") -> Column:
    """struct(class_index, confidence, threat_class) from class probabilities.

    policy "service": a benign verdict under 0.5 with an anomaly above 0.5 is an unknown anomaly.
    policy "library": any verdict not above 0.5 is an unknown anomaly.
    """
    probs, score = _col(probabilities), _col(anomaly)
    confidence = F.array_max(probs)
    index = (F.array_position(probs, confidence) - 1).cast("int")
    named = class_name(index, classes)
    if policy == "service":
        unknown = (named == "benign") & (confidence < 0.5) & (score > 0.5)
    elif policy == "library":
        unknown = confidence <= 0.5
    else:
        raise ValueError(f"unknown decision policy: {policy}")
    return F.struct(
        index.alias("class_index"),
        confidence.alias("confidence"),
        F.when(unknown, F.lit(UNKNOWN_ANOMALY)).otherwise(named).alias("threat_class"),
    )


def latency_band(milliseconds) -> Column:
    value = _col(milliseconds)
    return F.when(value < 100, "green").when(value < 500, "yellow").otherwise("red")


def megabytes(size) -> Column:
    return _col(size) / F.lit(1024.0 * 1024.0)


def is_grease(code) -> Column:
    """Reserved hello values: both bytes equal and of the form 0x?A."""
    value = _col(code)
    low = value.bitwiseAND(F.lit(0xFF))
    return (
        value.between(0x0A0A, 0xFAFA)
        & (F.shiftright(value, 8) == low)
        & (low.bitwiseAND(F.lit(0x0F)) == 0x0A)
    )


def _dashed(codes: Column) -> Column:
    kept = F.filter(codes, lambda code: ~is_grease(code))
    return F.array_join(F.transform(kept, lambda code: code.cast("string")), "-")


def ja3(version, ciphers, extensions, curves, point_formats) -> Column:
    """md5 of version and the four dashed code lists, reserved values left out."""
    parts = [_dashed(_col(c)) for c in (ciphers, extensions, curves, point_formats)]
    return F.md5(F.concat_ws(",", _col(version).cast("string"), *parts))


def ja3s(version, cipher) -> Column:
    """md5 of "version,cipher,"; null when the server chose a reserved value."""
    joined = F.concat(_col(version).cast("string"), F.lit(","), _col(cipher).cast("string"), F.lit(","))
    return F.when(~is_grease(cipher), F.md5(joined))
