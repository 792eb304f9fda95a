"""Text, number and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_half_up(x: Column) -> Column:
    """Nearest long, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def trim_body(body: Column | str, limit: int = 1024) -> Column:
    body = _c(body)
    return F.when(
        F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit(" ..."))
    ).otherwise(body)


def limit_body(body: Column | str, limit: int = 100_000) -> Column:
    """Mail body cut at `limit` characters with the number of characters left out."""

    def cut(text: Column) -> Column:
        left_out = F.format_number(F.length(text) - limit, 0)
        short = F.concat(F.substring(text, 1, limit), F.lit(" ... ("), left_out, F.lit(" more chars)"))
        return F.when(F.length(text) > limit, short).otherwise(text)

    return bind(_c(body), cut)


def mask_user_info(uri: Column | str) -> Column:
    """`user:secret@` becomes `user:*@`, a bare `token@` becomes `*@`; other URIs are unchanged."""
    uri = _c(uri)
    authority = r"^([A-Za-z][A-Za-z0-9+.\-]*://)"
    with_secret = authority + r"([^/?#@:]*):[^/?#@]*@"
    bare = authority + r"[^/?#@:]+@"
    masked = F.regexp_replace(uri, with_secret, "$1$2:*@")
    return F.regexp_replace(masked, bare, "$1*@")


def period_text(seconds: Column | str) -> Column:
    """Whole seconds as `1d 2h 3m 4s`, counting all days."""
    s = _c(seconds).cast("long")
    day, hour, minute = F.lit(86400), F.lit(3600), F.lit(60)
    return F.concat(
        F.floor(s / day).cast("string"),
        F.lit("d "),
        F.floor(s % day / hour).cast("string"),
        F.lit("h "),
        F.floor(s % hour / minute).cast("string"),
        F.lit("m "),
        (s % minute).cast("string"),
        F.lit("s"),
    )


def hours_text(millis: Column | str) -> Column:
    return F.format_string("%.2f H", _c(millis) / F.lit(3600000.0))


def count_text(n: Column | str, unit: str = "msg") -> Column:
    return F.format_string(f"%,d {unit}", _c(n).cast("long"))


def delta_text(messages: Column | str, millis: Column | str) -> Column:
    return F.format_string(
        "message delta: %,d, time delta: %,d ms", _c(messages).cast("long"), _c(millis).cast("long")
    )


def severity_name(text: Column | str) -> Column:
    return F.upper(F.replace(_c(text), F.lit("-"), F.lit("_")))


def alert_subject(severity: Column | str, service: Column | str, heading: Column | str) -> Column:
    return F.format_string("[%s] %s: %s", _c(severity), _c(service), _c(heading))


def entry_lines(data: Column | str) -> Column:
    """A string map as `key: value` lines in key order; null reads "null"."""
    entries = F.array_sort(F.map_entries(_c(data)))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), "\n"
    )


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    keys = F.map_keys(right)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(keys, k)), right)


def split_pair(text: Column | str, separator: str) -> Column:
    """`a<sep>b` as a two-element array, null for any other number of parts. `separator` is a
    regular expression."""
    return bind(F.split(_c(text), separator), lambda p: F.when(F.size(p) == 2, p))


def host_port(text: Column | str) -> Column:
    """`host:port` as struct(host, port), null when it has no such shape."""

    def endpoint(pair: Column) -> Column:
        port = F.element_at(pair, 2).try_cast("int")
        return F.when(port.isNotNull(), F.struct(pair[0].alias("host"), port.alias("port")))

    return bind(split_pair(F.trim(_c(text)), ":"), endpoint)


def track_text(track: Column | str) -> Column:
    return F.array_join(_c(track), "/")


def track_array(path: Column | str) -> Column:
    return F.split(_c(path), "/")


TOPIC_CHARS = "[a-zA-Z0-9._-]+"


def topic_of_path(path: Column | str, base: str = "") -> Column:
    """Topic of `<base>/brokers/topics/<topic>`, null for other paths."""
    return F.regexp_extract(_c(path), f"^{base}/brokers/topics/({TOPIC_CHARS})$", 1)


def partition_of_path(path: Column | str, base: str = "") -> Column:
    """struct(topic, partition) of a partition state path, null for other paths."""
    pattern = f"^{base}/brokers/topics/({TOPIC_CHARS})/partitions/([0-9]+)/state$"
    number = F.regexp_extract(_c(path), pattern, 2).try_cast("int")
    return F.when(
        number.isNotNull(),
        F.struct(F.regexp_extract(_c(path), pattern, 1).alias("topic"), number.alias("partition")),
    )
