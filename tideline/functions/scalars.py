"""Scalar functions as Column expressions.

All but ``datetime_to_ts`` and ``date_to_ts`` use the session's time zone; those
two read wall-clock text at a fixed offset, +08:00 unless given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(16,2)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# dates and times


def format_ms(ms: Column | str, pattern: str) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), pattern)


def ts_to_date(ms: Column | str) -> Column:
    return format_ms(ms, "yyyy-MM-dd")


def ts_to_datetime(ms: Column | str) -> Column:
    return format_ms(ms, "yyyy-MM-dd HH:mm:ss")


def ts_to_partition(ms: Column | str) -> Column:
    return format_ms(ms, "yyyyMMdd")


def format_ts(t: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_c(t), pattern)


def datetime_to_ts(text: Column | str, offset: str = "+08:00") -> Column:
    """Epoch milliseconds of ``yyyy-MM-dd HH:mm:ss`` at the offset; unreadable text gives null."""
    stamp = F.concat(F.trim(_c(text)), F.lit(offset))
    return F.unix_millis(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def date_to_ts(text: Column | str, offset: str = "+08:00") -> Column:
    return datetime_to_ts(F.concat(F.trim(_c(text)), F.lit(" 00:00:00")), offset)


def ms_string_to_date(text: Column | str) -> Column:
    """Date of epoch milliseconds held as text; text that is no number gives null."""
    return ts_to_date(F.expr("try_cast(NULL as bigint)") if text is None else _c(text).try_cast("bigint"))


def event_time(ms: Column | str) -> Column:
    return F.timestamp_millis(_c(ms))


def processing_time() -> Column:
    return F.current_timestamp()


def normalise_epoch(x: Column | str) -> Column:
    """Seconds (below 1e10) become milliseconds."""
    return F.when(_c(x) < F.lit(10_000_000_000), _c(x) * 1000).otherwise(_c(x))


def day_list(first: Column | str, last: Column | str) -> Column:
    """yyyymmdd numbers of all days, both ends included; empty when first is after last."""
    a, b = _c(first), _c(last)
    days = F.when(a <= b, F.sequence(a, b, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
    return F.transform(days, lambda d: F.date_format(d, "yyyyMMdd").cast("int"))


# numbers


def amount(num: Column | str, price: Column | str) -> Column:
    return _c(num).try_cast(MONEY) * _c(price).try_cast(MONEY)


def negate(x: Column | str) -> Column:
    """The negated amount; null counts as 0."""
    return -F.coalesce(_c(x), F.lit(0).cast(MONEY))


def hash_mod(x: Column | str, n: int = 128) -> Column:
    """Bucket of four digits from the last three hex digits of the md5."""
    return F.lpad((F.conv(F.right(F.md5(_c(x).cast("string").cast("binary")), F.lit(3)), 16, 10).cast("int") % n).cast("string"), 4, "0")


def hash_mod_hot(x: Column | str, hot: dict[str, str], n: int = 128) -> Column:
    """``hash_mod`` with buckets of their own for hot keys, compared in lower case."""
    key = F.lower(_c(x).cast("string"))
    own = F.lit(None).cast("string")
    for k, bucket in sorted(hot.items()):
        own = F.when(key == k.lower(), F.lit(bucket)).otherwise(own)
    return F.coalesce(own, hash_mod(x, n))


_HEX_CHUNK = 7  # 16^7 times a limb of nine decimal digits fits a long
_LIMB = 1_000_000_000


def _hex_digits(hexed: Column) -> Column:
    """Decimal digits of hex digits of any number: limbs base 1e9, lowest first, are multiplied chunk by chunk."""
    size = F.length(hexed)
    padded = F.lpad(hexed, F.ceil(size / _HEX_CHUNK).cast("int") * _HEX_CHUNK, "0")
    starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(_HEX_CHUNK))
    chunks = F.transform(starts, lambda i: F.conv(F.substr(padded, i, F.lit(_HEX_CHUNK)), 16, 10).cast("bigint"))
    none = F.array().cast("array<bigint>")

    def times(limbs: Column, chunk: Column) -> Column:
        total = lambda s, limb: limb * F.lit(16**_HEX_CHUNK) + s["carry"]
        return F.aggregate(
            limbs,
            F.struct(chunk.alias("carry"), none.alias("out")),
            lambda s, limb: F.struct((total(s, limb) / F.lit(_LIMB)).cast("bigint").alias("carry"), F.array_append(s["out"], total(s, limb) % F.lit(_LIMB)).alias("out")),
            lambda s: F.when(s["carry"] > 0, F.array_append(s["out"], s["carry"])).otherwise(s["out"]),
        )

    limbs = F.aggregate(chunks, none, times)
    return F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")


def hex_to_decimal(x: Column | str, divide: bool = False) -> Column:
    """Plain decimal text of ``0x...`` or of a decimal number, exact at any length; null gives '0'.

    ``divide`` scales by 1e-18 and leaves out zeros at the end that the input's scale did not have.
    Text that is neither gives null.
    """
    text = _c(x).cast("string")
    return _short_text(F.when(text.isNull(), F.lit("0")), text, divide).otherwise(_let(text, lambda t: _plain_text(t, divide)))


def _short_text(known: Column, text: Column, divide: bool) -> Column:
    """The common forms, by plain expressions that are compiled; limbs and arrays are for all others."""
    if not divide:
        exponent = F.split_part(F.lower(text), F.lit("e"), F.lit(2)).try_cast("int")
        return (
            known.when(text.rlike(r"^-?[1-9]\d*(\.\d+)?\z"), text)
            .when(text.rlike(r"^0x0*[0-9a-fA-F]{1,15}\z"), F.conv(F.substr(text, F.lit(3)), 16, 10))
            .when(text.rlike(r"^[1-9]\d*[eE]\d{1,4}\z"), F.concat(F.split_part(F.lower(text), F.lit("e"), F.lit(1)), F.repeat(F.lit("0"), exponent)))
        )
    kept = F.regexp_replace(text, "0{1,18}$", "")
    scale = 18 - F.length(text) + F.length(kept)
    digits = F.lpad(kept, F.greatest(F.length(kept), scale + 1), "0")
    point = F.length(digits) - scale
    whole = F.regexp_replace(F.substr(digits, F.lit(1), point), "^0+(?=.)", "")
    return known.when(text.rlike(r"^[1-9]\d*\z"), F.when(scale > 0, F.concat(whole, F.lit("."), F.substr(digits, point + 1, scale))).otherwise(whole))


_DECIMAL = r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,4}))?$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _plain_text(text: Column, divide: bool) -> Column:
    part = lambda i: F.regexp_extract(text, _DECIMAL, i)
    hexed = F.struct(
        text.startswith("0x-").alias("minus"), _hex_digits(F.regexp_replace(text, "^0x[+-]?", "")).alias("digits"), F.lit(0).alias("scale")
    )
    number = F.struct((part(1) == "-").alias("minus"), F.concat(part(2), part(3)).alias("digits"), (F.length(part(3)) - F.coalesce(part(4).try_cast("int"), F.lit(0))).alias("scale"))
    known = F.when(text.rlike("^0x[+-]?[0-9a-fA-F]+$"), hexed).when(text.rlike(_DECIMAL) & text.rlike(r"\d"), number)

    def scaled(n: Column) -> Column:
        zero = F.regexp_replace(n["digits"], "0", "") == ""
        minus = n["minus"] & ~zero
        if not divide:
            return F.struct(minus.alias("minus"), n["digits"].alias("digits"), n["scale"].alias("scale"))
        kept = F.regexp_replace(n["digits"], "0{1,18}$", "")
        return F.struct(
            minus.alias("minus"), F.when(zero, n["digits"]).otherwise(kept).alias("digits"),
            (n["scale"] + F.when(zero, F.lit(0)).otherwise(18 - F.length(n["digits"]) + F.length(kept))).alias("scale"),
        )

    def padded(n: Column) -> Column:
        full = F.concat(n["digits"], F.repeat(F.lit("0"), F.greatest(-n["scale"], F.lit(0))))
        return F.struct(n["minus"].alias("minus"), F.greatest(n["scale"], F.lit(0)).alias("scale"), F.lpad(full, F.greatest(F.length(full), n["scale"] + 1), "0").alias("digits"))

    def written(n: Column) -> Column:
        point = F.length(n["digits"]) - n["scale"]
        whole = F.regexp_replace(F.substr(n["digits"], F.lit(1), point), "^0+(?=.)", "")
        fraction = F.when(n["scale"] > 0, F.concat(F.lit("."), F.substr(n["digits"], point + 1, n["scale"]))).otherwise("")
        return F.concat(F.when(n["minus"], "-").otherwise(""), whole, fraction)

    return _let(known, lambda k: F.when(k.isNotNull(), _let(scaled(k), lambda n: _let(padded(n), written))))


# text


def append_json_list(items: Column | str, item: Column | str) -> Column:
    """JSON list of strings with one more item; null and unreadable lists are empty."""
    old = F.coalesce(F.from_json(_c(items), "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_append(old, _c(item)))


def hex_words(data: Column | str) -> Column:
    """Words of 64 hex digits after a two-character prefix, each with 0x in front."""
    body = F.substr(_c(data), F.lit(3))
    n = F.floor(F.length(body) / 64).cast("int")
    words = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("0x"), F.substr(body, (i - 1) * 64 + 1, F.lit(64))))
    return F.when(n > 0, words).otherwise(F.array().cast("array<string>"))


def to_csv(items: Column | str, sep: str = ", ") -> Column:
    return F.array_join(_c(items), sep)


def capitalise_first(x: Column | str) -> Column:
    return F.concat(F.upper(F.substr(_c(x), F.lit(1), F.lit(1))), F.substr(_c(x), F.lit(2)))


def lowercase_first(x: Column | str) -> Column:
    return F.concat(F.lower(F.substr(_c(x), F.lit(1), F.lit(1))), F.substr(_c(x), F.lit(2)))


def repeat(text: Column | str, n: Column | int) -> Column:
    return F.repeat(_c(text), n if isinstance(n, Column) else F.lit(n))


def zeros(n: Column | int) -> Column:
    return repeat(F.lit("0"), n)


def is_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x) == "", F.lit(True))


def is_blank(x: Column | str) -> Column:
    """Null, or nothing but characters up to U+0020."""
    return F.coalesce(_c(x).rlike(r"^[\x00-\x20]*$"), F.lit(True))


#: Fixed value: CJK characters, letters, digits and the marks allowed with them.
CHARSET = r'''^[\u4e00-\u9fa5a-zA-Z0-9\[\]\-_+{}:：“<>`?!——+·~@#$%^&*(、，。；‘【】！@#￥%……&*（）)"]+$'''


def matches_charset(x: Column | str, pattern: str = CHARSET) -> Column:
    return F.coalesce(_c(x).rlike(pattern), F.lit(False))


def camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def camel_columns(df: DataFrame) -> DataFrame:
    """UPPER_UNDERSCORE column names as lowerCamel."""
    return df.toDF(*(camel(c) for c in df.columns))


def row_key(columns: list[str], md5_columns: tuple[str, ...] = (), sep: str = "_", md5_all: bool = False) -> Column:
    """Composite key: chosen fields hashed, joined, and hashed as a whole if asked; nulls are empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat_ws(sep, *(F.md5(part(c).cast("binary")) if c in md5_columns else part(c) for c in columns))
    return F.md5(key.cast("binary")) if md5_all else key


def field(value: Column | str, *path: str) -> Column:
    """A map entry, then struct fields; a missing key gives null."""
    out = _c(value)
    for i, p in enumerate(path):
        out = F.try_element_at(out, F.lit(p)) if i == 0 else out[p]
    return out
