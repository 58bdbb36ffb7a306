"""Repository URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions.rows import bind
from inkprint.functions.scalars import trim_ws

_HOST_SCHEMES = ("http", "https", "ftp", "ws", "wss")
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_SLASHES = r"[/\\]*"  # a backslash counts as a slash before the query
# fixed values of the URL standard: what may stand as it is in a path, a query and a user's name; all else is encoded
_IN_PATH = r"[!$-;=@-_a-z|~]"
_IN_QUERY = r"[!$%&(-;=?-~]"
_IN_USER = r"[!$-.0-9A-Z_a-z~:]"
_DOT, _TWO_DOTS = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
# fixed values of the bootstring algorithm for hosts
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _FIRST_BIAS, _FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_NUMERIC_HOST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
_PRIVATE_IPV4 = (
    r"^(?:10|127|0)\.[0-9]+\.[0-9]+\.[0-9]+$|^169\.254\.[0-9]+\.[0-9]+$"
    r"|^172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+$|^192\.168\.[0-9]+\.[0-9]+$"
)
_PRIVATE_IPV6 = r"^::1$|^fe80:|^f[cd]"


def _number(label: Column) -> Column:
    """Value of an IPv4 part written in decimal, octal (leading 0) or hexadecimal (0x); else null."""
    return (
        F.when(label == "0x", F.lit(0).cast("bigint"))
        .when(label.rlike("^0x0*[0-9a-f]{1,8}$"), F.conv(F.substr(label, F.lit(3)), 16, 10).try_cast("bigint"))
        .when(label.rlike("^0[0-7]{1,16}$"), F.conv(label, 8, 10).try_cast("bigint"))
        .when(label.rlike("^(?:0|[1-9][0-9]{0,17})$"), label.try_cast("bigint"))
    )


def _ipv4_value(numbers: Column) -> Column:
    """The address as one number: each part but the last fills a byte, the last one the rest."""
    n = F.size(numbers)
    heads = F.slice(numbers, F.lit(1), n - 1)
    last = F.element_at(numbers, -1)
    sound = (
        (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(heads, lambda x: x > 255)
        & (last < F.pow(F.lit(256.0), 5 - n))
    )
    placed = F.transform(heads, lambda x, i: x * F.pow(F.lit(256.0), 3 - i).cast("bigint"))
    return F.when(sound, F.aggregate(placed, last, lambda total, x: total + x))


def percent_encoded(text: Column, allowed: str) -> Column:
    """Every character that is not ``allowed`` as the hexadecimal bytes of its UTF-8; escapes stay as they are."""
    escape = lambda ch: F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
    each = F.transform(F.split(text, ""), lambda ch: F.when(ch.rlike(f"^(?:{allowed}|%)$"), ch).otherwise(escape(ch)))
    return F.when(text.rlike(f"^(?:{allowed}|%)*$"), text).otherwise(F.array_join(each, ""))


def resolved_path(path: Column) -> Column:
    """A path without ``.`` and ``..``, percent-encoded; it begins with a slash."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "^/", ""), "/")
    indexed = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i == F.size(parts) - 1).alias("is_last")))

    def step(kept: Column, part: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        left = F.when(part["p"].rlike(_TWO_DOTS), shorter).otherwise(kept)
        is_dot = part["p"].rlike(_DOT) | part["p"].rlike(_TWO_DOTS)
        added = F.when(~is_dot, F.array(part["p"])).when(part["is_last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(left, added)

    kept = F.aggregate(indexed, F.array().cast("array<string>"), step)
    return percent_encoded(F.concat(F.lit("/"), F.array_join(kept, "/")), _IN_PATH)


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta has been written."""
    start = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))
    state = lambda d, k: F.struct(d.cast("bigint").alias("d"), k.cast("bigint").alias("k"))
    limit = ((_BASE - _T_MIN) * _T_MAX) // 2
    scaled = F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), state(start + F.floor(start / points), F.lit(0)),
        lambda s, _: F.when(s["d"] > limit, state(F.floor(s["d"] / (_BASE - _T_MIN)), s["k"] + _BASE)).otherwise(s),
    )
    return bind(scaled, lambda s: s["k"] + F.floor((_BASE - _T_MIN + 1) * s["d"] / (s["d"] + _SKEW)))


def _written_delta(delta: Column, bias: Column) -> Column:
    """A delta as digits of changing base, the last one below its threshold."""
    state = lambda q, out, done: F.struct(q.cast("bigint").alias("q"), out.alias("out"), done.alias("done"))
    digit = lambda v: F.substr(F.lit(_DIGITS), (v + 1).cast("int"), F.lit(1))

    def step(s: Column, k: Column) -> Column:
        def with_threshold(t: Column) -> Column:
            more = state(F.floor((s["q"] - t) / (_BASE - t)), F.concat(s["out"], digit(t + (s["q"] - t) % (_BASE - t))), F.lit(False))
            return F.when(s["q"] < t, state(s["q"], F.concat(s["out"], digit(s["q"])), F.lit(True))).otherwise(more)

        return F.when(s["done"], s).otherwise(bind(F.least(F.greatest(k * _BASE - bias, F.lit(_T_MIN)), F.lit(_T_MAX)), with_threshold))

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), state(delta, F.lit(""), F.lit(False)), step, lambda s: s["out"])


def ascii_label(label: Column) -> Column:
    """A label of a host name in ASCII: unchanged, or ``xn--`` and its bootstring.

    Characters beyond ASCII are written in the order of their code points, each as the distance in
    (code point, place) from the one before. Letters should be composed and in lower case.
    """
    characters = F.split(label, "")
    coded = F.transform(characters, lambda ch, i: F.struct(_code_point(ch).alias("code"), i.cast("bigint").alias("at")))
    state = lambda n, i, h, bias, out: F.struct(
        n.cast("bigint").alias("n"), i.cast("bigint").alias("i"), h.cast("bigint").alias("h"), bias.cast("bigint").alias("bias"), out.alias("out")
    )

    def write(coded: Column) -> Column:
        basic = F.filter(coded, lambda c: c["code"] < _FIRST_CODE)
        others = F.sort_array(F.filter(coded, lambda c: c["code"] >= _FIRST_CODE))
        plain = F.regexp_replace(label, r"[^\x00-\x7F]", "")
        lead = F.concat(plain, F.when(F.length(plain) > 0, "-").otherwise(""))

        def step(s: Column, c: Column) -> Column:
            # characters written already that stand before this one
            before = F.size(F.filter(coded, lambda o: (o["at"] < c["at"]) & (o["code"] <= c["code"])))
            delta = (c["code"] - s["n"]) * (s["h"] + 1) + before - s["i"]
            return bind(delta, lambda d: state(
                c["code"], before + 1, s["h"] + 1, _adapted(d, s["h"] + 1, s["h"] == F.size(basic)), F.concat(s["out"], _written_delta(d, s["bias"])),
            ))

        start = state(F.lit(_FIRST_CODE), F.lit(0), F.size(basic), F.lit(_FIRST_BIAS), lead)
        return F.concat(F.lit("xn--"), F.aggregate(others, start, step, lambda s: s["out"]))

    return F.when(label.rlike(r"^[\x00-\x7F]*$"), label).otherwise(bind(coded, write))


def _code_point(ch: Column) -> Column:
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint")


def ascii_host(host: Column) -> Column:
    """A host name label by label in ASCII; ideographic full stops separate labels too."""
    dotted = F.translate(host, "\u3002\uff0e\uff61", "...")
    return F.when(host.rlike(r"^[\x00-\x7F]*$"), host).otherwise(F.array_join(F.transform(F.split(dotted, r"\."), ascii_label), "."))


def is_private_host(host: Column) -> Column:
    """Local names, private IPv4 ranges and private IPv6 prefixes."""
    named = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    return named | host.rlike(_PRIVATE_IPV4) | (host.contains(":") & host.rlike(_PRIVATE_IPV6))


def audit_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """adds ``host``, ``error`` (null if the URL is accepted) and ``canonical``.

    The host is in lower case and ASCII without user, port or brackets, IPv4 in dotted form
    (``127.1`` is ``127.0.0.1``). An accepted URL loses its fragment and default port, its path is
    resolved, and path, query and user are percent-encoded, each by its own set. Each step is a
    column of its own, so that nothing is evaluated twice.
    """
    text = F.col("_text")
    staged = df.withColumn("_text", F.regexp_replace(trim_ws(F.coalesce(F.col(url), F.lit(""))), r"[\t\n\r]", ""))
    staged = staged.withColumns({
        "_scheme": F.lower(F.regexp_extract(text, _SCHEME, 1)),
        # between the slashes after the scheme and the next slash, question mark or hash
        "_place": F.regexp_extract(text, _SCHEME + _SLASHES + r"([^/?#\\]*)", 2),
        "_rest": F.regexp_replace(F.regexp_replace(text, r"(?s)#.*$", ""), _SCHEME + _SLASHES + r"[^/?#\\]*", ""),
    })
    staged = staged.withColumns({
        "_user": F.regexp_extract("_place", r"^(.*@)", 1),
        "_port": F.regexp_extract("_place", r"(:[0-9]*)$", 1),
        "_written": F.lower(F.regexp_replace("_place", r"^.*@|:[0-9]*$", "")),
        "_path": F.regexp_extract("_rest", r"^([^?]*)", 1),
        "_query": F.regexp_extract("_rest", r"(?s)(\?.*)$", 1),
    })
    staged = staged.withColumn("_name", ascii_host(F.regexp_replace("_written", r"^\[|\]$", "")))
    name = F.col("_name")
    numeric = name.rlike(_NUMERIC_HOST) & ~name.contains(":")
    labels = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    staged = staged.withColumn("_numbers", F.when(numeric, F.transform(labels, _number)))
    staged = staged.withColumn("_ip", F.when(F.col("_numbers").isNotNull(), _ipv4_value(F.col("_numbers"))))
    byte = lambda i: (F.floor(F.col("_ip") / 256 ** (3 - i)) % 256).cast("string")
    staged = staged.withColumn(
        "host",
        F.when(F.col("_numbers").isNull(), name)
        .when(F.col("_ip").isNull(), F.lit(""))
        .otherwise(F.concat_ws(".", *[byte(i) for i in range(4)])),
    )
    host, scheme = F.col("host"), F.col("_scheme")
    broken = (scheme == "") | (
        scheme.isin(*_HOST_SCHEMES) & ((host == "") | F.col("_place").rlike(rf"[{fixed.WS}<>^|%]"))
    )
    staged = staged.withColumn(
        "error",
        F.when(text == "", fixed.URL_MISSING)
        .when(broken, fixed.URL_INVALID)
        .when(scheme != "https", fixed.URL_NOT_HTTPS)
        .when(is_private_host(host), fixed.URL_PRIVATE),
    )
    shown = F.when(F.col("_written").startswith("["), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    port = F.when(F.col("_port").isin(":", ":443"), "").otherwise(F.col("_port"))
    user = F.regexp_extract("_user", r"^(.*)@$", 1)
    encoded_user = F.when(user == "", "").otherwise(F.concat(percent_encoded(user, _IN_USER), F.lit("@")))
    query = percent_encoded(F.col("_query"), _IN_QUERY)
    whole = F.concat(F.lit("https://"), encoded_user, shown, port, resolved_path(F.col("_path")), query)
    staged = staged.withColumn("canonical", F.when(F.col("error").isNull(), whole))
    return staged.drop("_text", "_scheme", "_place", "_rest", "_path", "_query", "_user", "_port", "_written", "_name", "_numbers", "_ip")


def repo_name(url: Column) -> Column:
    """Last path part without ``.git``."""
    cleaned = F.regexp_replace(trim_ws(url), r"/+$", "")
    last = F.regexp_replace(F.regexp_extract(cleaned, r"/([^/]+)$", 1), r"(?i)\.git$", "")
    return F.coalesce(F.nullif(last, F.lit("")), F.lit("repository"))


def scan_id(name: Column, epoch_ms: Column) -> Column:
    """``scan_<name>_<last six base-36 digits of the time>``"""
    clean = F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_"))
    return F.concat(F.lit("scan_"), clean, F.lit("_"), F.right(F.lower(F.conv(epoch_ms.cast("string"), 10, 36)), F.lit(6)))
