"""Readable evidence for a scored flow: number text, labels, top contributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsift.functions.bind import bind
from flowsift.schema import BOOL_COLUMNS, FEATURE_COLUMNS

# fixed values: the readable name of each model feature
FEATURE_LABELS = {
    "packets_per_sec": "High packet rate",
    "bytes_per_sec": "High traffic volume",
    "outbound_inbound_ratio": "High outbound traffic ratio",
    "orig_bytes": "Large originator byte volume",
    "resp_bytes": "Large responder byte volume",
    "orig_pkts": "Many originator packets",
    "resp_pkts": "Many responder packets",
    "fan_out": "Connections to many destinations",
    "fan_in": "Many sources contacting this destination",
    "unique_dst_ips": "Many destination IPs contacted",
    "unique_dst_ports": "Many destination ports contacted",
    "iat_mean": "Average connection interval",
    "iat_std": "Variable connection timing",
    "iat_min": "Short connection interval",
    "iat_max": "Long connection interval",
    "connection_frequency": "Frequent connections from source",
    "src_ip_entropy": "Diverse destination IP activity",
    "periodicity_score": "Regular connection timing",
    "dns_query_entropy": "High DNS query entropy",
    "domain_length_mean": "Long DNS domain names",
    "domain_length_max": "Very long DNS domain name",
    "subdomain_count": "Many DNS subdomains",
    "dns_record_type_a_ratio": "High A-record query ratio",
    "dns_record_type_txt_ratio": "High TXT-record query ratio",
    "dns_query_count": "Frequent DNS queries",
    "tls_version": "TLS version",
    "cipher_suite_enc": "Unusual TLS cipher suite",
    "is_tls": "TLS traffic detected",
    "ja4_hash_enc": "Unusual JA4 fingerprint",
    "is_quic": "QUIC traffic detected",
    "quic_0rtt": "QUIC 0-RTT activity",
    "quic_pkt_size_mean": "Large QUIC packet size",
    "quic_pkt_size_std": "Irregular QUIC packet sizing",
    "src_port": "Source port",
    "dst_port": "Destination port",
    "duration": "Connection duration",
}


# d.ddd5 and nothing but zeros: the shortest text of the number is half way
_HALF_WAY = r"^(-?)(\d)\.(\d{3})50*e(.*)$"


def _below_half(value: Column, half: Column, exponent: Column) -> Column:
    """Whether |value| rounds down at five digits: below the half, or on it with an even digit.

    The half is half * 10 ** (exponent - 4). The value is m * 2 ** -shift, so both sides are
    compared as whole numbers.
    """
    whole = "decimal(38,0)"
    size = F.abs(value)
    shift = (F.lit(53) - F.floor(F.log2(size))).cast("int")
    one = F.lit(1).cast("bigint")
    low = F.call_function("shiftleft", one, F.least(shift, F.lit(46))).cast("decimal(15,0)")
    high = F.call_function("shiftleft", one, F.greatest(shift - 46, F.lit(0))).cast("decimal(17,0)")
    mantissa = (size * F.pow(F.lit(2.0), shift)).cast("bigint").cast("decimal(19,0)")
    ten = F.pow(F.lit(10.0), F.lit(4) - exponent).cast("bigint").cast("decimal(18,0)")
    order = (mantissa * ten).cast(whole) - ((half.cast("decimal(5,0)") * low).cast("decimal(20,0)") * high).cast(whole)
    even = F.substring(half, 4, 1).isin("0", "2", "4", "6", "8")
    # from five whole digits on the half is exact; under 1e-12 the shortest text decides
    return (
        F.when(exponent >= 4, even).when(exponent < -12, F.lit(False))
        .otherwise(bind(order, lambda o: (o < 0) | ((o == 0) & even)))
    )


def _three_decimals(value: Column, digits: Column) -> Column:
    """Scientific text with three decimals, rounded by the binary value, exact halves to even.

    The formatter rounds the shortest text half up, so only half-way texts need a closer look.
    """
    group = lambda i: F.regexp_extract(digits, _HALF_WAY, i)
    kept = F.concat(group(1), group(2), F.lit("."), group(3), F.lit("e"), group(4))
    half = F.concat(group(2), group(3), F.lit("5"))
    down = F.when(digits.rlike(_HALF_WAY), _below_half(value, half, group(4).try_cast("int"))).otherwise(F.lit(False))
    return F.when(down, kept).otherwise(F.format_string("%.3e", value))


def _shortest(scientific: Column) -> Column:
    mantissa, exponent = F.split(scientific, "e")[0], F.split(scientific, "e")[1].try_cast("int")
    fixed = F.regexp_replace(scientific.try_cast("decimal(12,7)").cast("string"), r"\.?0+$", "")
    signed = F.format_string("%s%02d", F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent))
    far = F.concat(F.regexp_replace(mantissa, r"\.?0+$", ""), F.lit("e"), signed)
    return F.when((exponent >= -4) & (exponent < 4), fixed).otherwise(far)


def g4(value: Column) -> Column:
    """Four significant digits without trailing zeros, exponent form outside 1e-4 .. 1e4."""
    number = value.cast("double")
    shown = F.struct(number.alias("v"), F.format_string("%.17e", number).alias("digits"))
    text = bind(bind(shown, lambda s: _three_decimals(s["v"], s["digits"])), _shortest)
    return F.when(number == 0, F.lit("0")).otherwise(text)


def _lookup(names: list[str], values: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in zip(names, values) for x in pair])


def feature_label(name: Column) -> Column:
    labels = _lookup(list(FEATURE_LABELS), list(FEATURE_LABELS.values()))
    return F.coalesce(F.try_element_at(labels, name), name)


def evidence_text(item: Column) -> Column:
    """Text of one struct(feature, label, value, contribution, direction)."""
    flag = item["feature"].isin(*BOOL_COLUMNS) & (item["value"] != 0)
    body = F.when(flag, item["label"]).otherwise(F.concat(item["label"], F.lit(": "), g4(item["value"])))
    return F.concat(body, F.lit(" ("), item["direction"], F.lit(" prediction)"))


def _strongest(values: list | None, contributions: list | None, most: int) -> list[tuple] | None:
    """(position, value, contribution) of one row by falling size; none of a size comes first, no number last."""
    if contributions is None:
        return None
    size = lambda i: (0, 0.0) if (c := contributions[i]) is None else (2, 0.0) if c != c else (1, -abs(c))
    return [(i, None if values is None else values[i], contributions[i])
            for i in sorted(range(len(contributions)), key=size)[:most]]


def _top_items(values: pa.Array, contributions: pa.Array, most: int, names: list[str]) -> pa.Array:
    count = len(contributions)
    flat, met = contributions.flatten(), values.flatten()
    width = len(flat) // count if count else 0
    regular = (count > 0 and not (contributions.null_count or values.null_count or flat.null_count)
               and all(pc.all(pc.equal(pc.list_value_length(x), width)).as_py() for x in (contributions, values)))
    if regular:
        sizes = -np.abs(flat.to_numpy(zero_copy_only=False).reshape(count, width))
        position = np.argsort(sizes, axis=1, kind="stable")[:, :most]
        place = (position + np.arange(count)[:, None] * width).ravel()
        ends, gone = np.arange(count + 1) * position.shape[1], np.zeros(count, bool)
        position, value, moved = position.ravel(), met.take(pa.array(place)), flat.take(pa.array(place))
    else:
        rows = [_strongest(v, c, most) for v, c in zip(values.to_pylist(), contributions.to_pylist())]
        ends, gone = np.cumsum([0, *(len(r or ()) for r in rows)]), np.array([r is None for r in rows], bool)
        items = [item for row in rows for item in row or ()]
        position = np.array([i for i, _, _ in items], int)
        value, moved = (pa.array([item[k] for item in items], pa.float64()) for k in (1, 2))
    shown = pa.array([FEATURE_LABELS.get(n, n) for n in names], pa.string())
    supports = pc.fill_null(pc.or_(pc.greater_equal(moved, 0.0), pc.is_nan(moved)), False)
    items = pa.StructArray.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(position)), shown.take(pa.array(position)), value, moved,
         pc.if_else(supports, "supports", "opposes")],
        ["feature", "label", "value", "contribution", "direction"])
    # a row without a start is null
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32), mask=np.append(gone, False)), items)


def top_contributions(values: Column, contributions: Column, top_k: int = 5,
                      names: list[str] = FEATURE_COLUMNS) -> Column:
    """The k features with the largest absolute contribution, ties by feature order; ranked in Arrow batches."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive integer")
    most, named = min(top_k, len(names)), list(names)

    @F.arrow_udf("array<struct<feature:string,label:string,value:double,contribution:double,direction:string>>")
    def top(values: pa.Array, contributions: pa.Array) -> pa.Array:
        return _top_items(values, contributions, most, named)

    return top(values.cast("array<double>"), contributions.cast("array<double>"))


def _listed(values: pa.Array) -> list:
    """The values as Python's own; at once where nothing is null."""
    return values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()


def _item_text(feature: str, label: str, value: float | None, direction: str) -> str | None:
    if value is None:
        return None
    body = label if feature in BOOL_COLUMNS and value != 0 else f"{label}: {value:.4g}" if value else f"{label}: 0"
    return f"{body} ({direction} prediction)"


def evidence_texts(contributions: Column) -> Column:
    """`evidence_text` of all items, in Arrow batches; Python's four digits follow the binary value as `g4` does."""
    @F.arrow_udf("array<string>")
    def texts(rows: pa.Array) -> pa.Array:
        items = rows.flatten()
        of = lambda name: _listed(pc.struct_field(items, name))
        made = map(_item_text, *(of(name) for name in ("feature", "label", "value", "direction")))
        size, gone = pc.fill_null(pc.list_value_length(rows), 0), rows.is_null().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False))]).astype(np.int32)
        starts = pa.array(ends, mask=np.append(gone, False))
        return pa.ListArray.from_arrays(starts, pa.array(list(made), pa.string()))

    return texts(contributions)
