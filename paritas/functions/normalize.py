"""Canonical text of values, by type: equal values of different stores become equal strings.

Two profiles. The table profile (normalize) is for set-based checksums and maps null to a type's default. The record
profile (record) is for the merge comparison, whose nulls are empty strings and whose bad values become a type's default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE, TIME, SECOND = "yyyy-MM-dd", "HH:mm:ss", "yyyy-MM-dd HH:mm:ss"
COMPARISONS = ("EXACT", "DATE_ONLY", "TRUNCATE_TO_SECOND", "TRUNCATE_TO_DAY")


@dataclass(frozen=True)
class Rule:
    """How one family of types is written. Unset values take the family's default."""

    precision: int | None = None
    rounding: str = "half_up"  # or truncate
    format: str | None = None
    timezone: str | None = None
    source_timezone: str | None = None
    comparison: str = "EXACT"
    encoding: str = "hex"  # or base64
    uppercase: bool = True
    true_value: str = "1"
    false_value: str = "0"
    null_value: str | None = None
    trim: bool = True

    def __post_init__(self) -> None:
        if self.precision is not None and not 0 <= self.precision <= 10:
            raise ValueError(f"precision must be from 0 to 10, not {self.precision}")
        for name, value, known in (("rounding", self.rounding, ("half_up", "truncate")), ("comparison", self.comparison, COMPARISONS), ("encoding", self.encoding, ("hex", "base64"))):
            if value not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {value}")


#: Names that a rule may use for a family of types.
FAMILIES = {
    "string": "string", "varchar": "string", "char": "string", "text": "string", "clob": "string", "enum": "string", "set": "string",
    "integer": "integer", "int": "integer", "tinyint": "integer", "smallint": "integer", "bigint": "integer", "long": "integer",
    "decimal": "decimal", "numeric": "decimal", "double": "double", "float": "float", "real": "float",
    "boolean": "boolean", "bit": "boolean", "date": "date", "time": "time", "time_with_timezone": "time",
    "datetime": "datetime", "timestamp_ntz": "datetime", "timestamp": "timestamp", "timestamp_with_timezone": "timestamp",
    "binary": "binary", "varbinary": "binary", "blob": "binary", "json": "json", "jsonb": "json", "uuid": "default", "array": "default", "default": "default",
}
Rules = dict[str, Rule]


def family(dtype: T.DataType) -> str:
    for kinds, name in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.DecimalType,), "decimal"),
        ((T.DoubleType,), "double"),
        ((T.FloatType,), "float"),
        ((T.BooleanType,), "boolean"),
        ((T.DateType,), "date"),
        ((T.TimestampNTZType,), "datetime"),
        ((T.TimestampType,), "timestamp"),
        ((T.BinaryType,), "binary"),
        ((T.StringType, T.CharType, T.VarcharType), "string"),
    ):
        if isinstance(dtype, kinds):
            return name
    return "time" if type(dtype).__name__ == "TimeType" else "default"


def compatible(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of two types can be compared as text of one family."""
    alike = {"integer": "number", "decimal": "number", "double": "number", "float": "number", "datetime": "moment", "timestamp": "moment", "date": "moment"}
    x, y = family(a), family(b)
    return alike.get(x, x) == alike.get(y, y)


def _or(value: Column, rule: Rule, default: str) -> Column:
    return F.coalesce(value, F.lit(default if rule.null_value is None else rule.null_value))


def string(c: Column, rule: Rule = Rule()) -> Column:
    return _or(F.trim(c) if rule.trim else c, rule, "")


def integer(c: Column, rule: Rule = Rule()) -> Column:
    return _or(c.cast("string"), rule, "0")


def number(c: Column, rule: Rule = Rule(), precision: int = 4) -> Column:
    """Fixed decimals, rounded half up or cut; exact in decimal(38, p) arithmetic, so that no exponent can appear.

    Values that have no such decimals keep their own text: NaN, infinities, and numbers too large for them.
    """
    p = precision if rule.precision is None else rule.precision
    if rule.rounding == "truncate":
        wide = c.try_cast(T.DecimalType(37, 10))
        whole = F.floor(F.abs(wide)).cast(T.DecimalType(27, 0))
        # The digits after the point by themselves, as a scaled number may not fit.
        rest = F.floor((F.abs(wide) % F.lit(1)).cast(T.DecimalType(11, 10)) * F.lit(10**p)).cast(T.DecimalType(12, 0)) / F.lit(10**p).cast(T.DecimalType(12, 0))
        cut = whole + rest.cast(T.DecimalType(11, p))
        value = F.when(wide < 0, -cut).otherwise(cut).cast(T.DecimalType(38, p))
    else:
        value = c.try_cast(T.DecimalType(38, p))
    zero = "0" if p == 0 else "0." + "0" * p
    return _or(F.coalesce(value.cast("string"), c.cast("string")), rule, zero)


def boolean(c: Column, rule: Rule = Rule()) -> Column:
    missing = rule.false_value if rule.null_value is None else rule.null_value
    return F.when(c, F.lit(rule.true_value)).when(c.isNull(), F.lit(missing)).otherwise(F.lit(rule.false_value))


def _moment(c: Column, rule: Rule, pattern: str) -> Column:
    if rule.comparison in ("DATE_ONLY", "TRUNCATE_TO_DAY"):
        pattern = DATE if rule.format is None else rule.format
        c = F.date_trunc("DAY", c)
    elif rule.comparison == "TRUNCATE_TO_SECOND":
        c = F.date_trunc("SECOND", c)
    return _or(F.date_format(c, rule.format or pattern), rule, "")


def date(c: Column, rule: Rule = Rule()) -> Column:
    return _or(F.date_format(c, rule.format or DATE), rule, "")


def datetime(c: Column, rule: Rule = Rule()) -> Column:
    """A zoneless timestamp; moved from source_timezone (UTC) to timezone only where a rule names one."""
    if rule.timezone:
        c = F.convert_timezone(F.lit(rule.source_timezone or "UTC"), F.lit(rule.timezone), c.cast("timestamp_ntz"))
    return _moment(c, rule, SECOND)


def timestamp(c: Column, rule: Rule = Rule()) -> Column:
    """A moment, written in UTC or the rule's timezone whatever the session's is."""
    local = F.convert_timezone(F.current_timezone(), F.lit(rule.timezone or "UTC"), c.cast("timestamp_ntz"))
    return _moment(local, rule, SECOND)


def time(c: Column, rule: Rule = Rule()) -> Column:
    """Hours to seconds; a zone or fraction after them is dropped."""
    return _or(F.regexp_extract(c.cast("string"), r"^(\d{2}:\d{2}:\d{2})", 1), rule, "")


def binary(c: Column, rule: Rule = Rule()) -> Column:
    text = F.base64(c) if rule.encoding == "base64" else F.hex(c) if rule.uppercase else F.lower(F.hex(c))
    return _or(text, rule, "")


def json(c: Column, rule: Rule = Rule()) -> Column:
    return _or(c.cast("string"), rule, "")


def default(c: Column, rule: Rule = Rule(), dtype: T.DataType | None = None) -> Column:
    """Text of the remaining types: arrays, maps and structs as JSON, maps in order of their keys."""
    if isinstance(dtype, T.MapType):
        c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    elif isinstance(dtype, T.ArrayType | T.StructType):
        c = F.to_json(c)
    return _or(F.trim(c.cast("string")), rule, "")


#: The canonicalisers by family; more can be registered.
NORMALIZERS: dict[str, Callable[[Column, Rule], Column]] = {
    "string": string, "integer": integer, "decimal": number, "double": number, "float": lambda c, r: number(c.cast("double"), r, 6),
    "boolean": boolean, "date": date, "time": time, "datetime": datetime, "timestamp": timestamp, "binary": binary, "json": json,
}


def normalize(c: Column, dtype: T.DataType, rules: Rules | None = None, strict_nulls: bool = False) -> Column:
    """c as canonical text. strict_nulls keeps nulls null instead of a default that a value could have too."""
    name = family(dtype)
    rule = (rules or {}).get(name, Rule())
    text = NORMALIZERS[name](c, rule) if name in NORMALIZERS else default(c, rule, dtype)
    return F.when(c.isNotNull(), text) if strict_nulls else text


def rule_of(operation: str, params: dict[str, Any], base: Rule | None = None) -> Rule:
    """The rule that a configured operation gives, over base."""
    base, take = base or Rule(), dict(params)
    rename = {"format_number": {}, "format_datetime": {"comparisonMode": "comparison"}, "encode": {"format": "encoding"}, "map_boolean": {"trueValue": "true_value", "falseValue": "false_value", "nullValue": "null_value"}, "normalize_string": {"nullValue": "null_value"}}
    if operation not in rename:
        raise ValueError(f"no normalization operation {operation!r}; there are {', '.join(rename)}")
    known = {"format_number": {"precision", "rounding"}, "format_datetime": {"format", "timezone", "comparison"}, "encode": {"encoding", "uppercase"}, "map_boolean": {"true_value", "false_value", "null_value"}, "normalize_string": {"trim", "null_value"}}[operation]
    named = {rename[operation].get(k, k): v for k, v in take.items()}
    if extra := set(named) - known:
        raise ValueError(f"{operation} has no parameter {', '.join(sorted(extra))}")
    if "rounding" in named:
        named["rounding"] = str(named["rounding"]).lower()
    if "comparison" in named:
        named["comparison"] = str(named["comparison"]).upper()
    return replace(base, **named)


def rules_of(entries: list[dict[str, Any]], base: Rules | None = None) -> Rules:
    """Rules from configuration: entries of {match: {type}, operation, params}; a later entry adds to an earlier one."""
    out = dict(base or {})
    for entry in entries:
        match = entry.get("match", {})
        if "path" in match:
            raise ValueError("rules for single fields are reserved; match a type")
        name = str(match.get("type", "")).lower()
        if name not in FAMILIES:
            raise ValueError(f"no type {name!r} to match")
        out[FAMILIES[name]] = rule_of(entry["operation"], entry.get("params", {}), out.get(FAMILIES[name]))
    return out


# -- the record profile ---------------------------------------------------------------------------------------------

_CONTROL = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of values that are computed once: a column that is named several times stands, and is analysed, as often."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def _fixed(c: Column, places: int) -> Column:
    """A double with places decimals, rounded from its exact binary value, halves to even, as C writes it. Java's own format
    rounds the shortest text that reads as the double, halves away from zero: the same, but where that text ends in a half, or
    has more than 15 digits to it.
    """
    parts = 1 << 37
    whole = lambda x: F.floor(x["size"])
    rest = lambda x: (x["size"] - F.floor(x["size"])) * float(parts)
    # The fraction is high / 2 ** 37 + low / 2 ** 74; what is below that is only of fractions that round to none.
    split = lambda x: _let(scaled, whole=x["whole"], high=F.floor(x["rest"]) * 10**places, low=F.floor((x["rest"] - F.floor(x["rest"])) * float(parts)) * 10**places)
    scaled = lambda x: _let(cut, whole=x["whole"], high=x["high"] + F.shiftright(x["low"], 37), low=x["low"].bitwiseAND(F.lit(parts - 1)))
    cut = lambda x: _let(up, whole=x["whole"], digits=F.shiftright(x["high"], 37), over=x["high"].bitwiseAND(F.lit(parts - 1)), low=x["low"])

    def up(x: Column) -> Column:
        more = (x["over"] > parts // 2) | ((x["over"] == parts // 2) & ((x["low"] > 0) | (x["digits"] % 2 == 1)))
        return _let(near, whole=x["whole"], digits=x["digits"] + more.cast("bigint"))

    def near(x: Column) -> Column:
        full = x["digits"] == 10**places
        return F.concat((x["whole"] + full.cast("bigint")).cast("string"), F.lit("."), F.lpad(F.when(full, F.lit("0")).otherwise(x["digits"].cast("string")), places, "0"))

    def far(x: Column) -> Column:
        """From 2 ** 53 on doubles are whole numbers: sums of three parts."""
        exact, top = "decimal(38,0)", F.floor(x["size"] / float(parts**2))
        left = x["size"] - top * float(parts**2)
        middle = F.floor(left / float(parts))
        total = top.cast(exact) * F.lit(str(parts**2)).cast(exact) + middle.cast(exact) * F.lit(parts).cast(exact) + F.floor(left - middle * float(parts)).cast(exact)
        return F.concat(total.cast(exact).cast("string"), F.lit("." + "0" * places))

    size, text = F.abs(c), F.format_string(f"%.{places + 1}f", c)
    exact = F.when(size < float(1 << 53), _let(lambda x: _let(split, whole=whole(x), rest=rest(x)), size=size)).otherwise(_let(far, size=size))
    odd = (size < 1e38) & ((size >= 10.0 ** (14 - places)) | (text.endswith("5") & (text.cast("double") == c)))
    return F.when(odd, F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), exact)).otherwise(F.format_string(f"%.{places}f", c))


_LIMB = 30


def _product(number: Column, fives: Column, twos: Column) -> Column:
    """number * 5 ** fives * 2 ** twos as limbs of 30 bits, the least first."""
    mask = F.lit((1 << _LIMB) - 1)

    def power(base: int, n: int, times: Column) -> Column:
        rest = F.element_at(F.array(*[F.lit(base**i).cast("bigint") for i in range(n)]), (times % n + 1).cast("int"))
        return F.concat(F.array_repeat(F.lit(base**n).cast("bigint"), F.floor(times / n).cast("int")), F.array(rest))

    def times(limbs: Column, factor: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            made = v * factor + s["carry"]
            return F.struct(F.concat(s["out"], F.array(made.bitwiseAND(mask))).alias("out"), F.shiftright(made, _LIMB).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("carry"))
        return F.aggregate(limbs, start, step, lambda s: F.concat(s["out"], F.array(s["carry"])))

    return F.aggregate(F.concat(power(5, 11, fives), power(2, 26, twos)), F.array(number.bitwiseAND(mask), F.shiftright(number, _LIMB)), times)


def _scientific(c: Column) -> Column:
    """A double with seven digits and an exponent, rounded as in _fixed. Only a double that is the nearest to a number of eight
    digits that ends with 5 is rounded by its exact value; for others no such number is between that and the shortest text (but
    for doubles below 2 ** -1022, which have fewer digits, and keep Java's).
    """
    size, text = F.abs(c), F.format_string("%.7e", F.abs(c))

    def parts(x: Column) -> Column:
        """size = m * 2 ** e, scaled in steps that are exact for the least doubles too, beside t * 10 ** k."""
        scaled = F.when(x["size"] < 1, x["size"] * 2.0**600).otherwise(x["size"] * 2.0**-600)
        t = F.replace(F.substring(x["text"], 1, 9), F.lit("."), F.lit("")).cast("bigint")
        k = F.substring_index(x["text"], "e", -1).cast("int") - 7
        return _let(mantissa, t=t, k=k, scaled=scaled, e=F.floor(F.log2(scaled)) - 53, by=F.when(x["size"] < 1, -600).otherwise(600))

    def mantissa(x: Column) -> Column:
        return _let(limbs, t=x["t"], k=x["k"], m=(x["scaled"] * F.pow(F.lit(2.0), -x["e"])).cast("bigint"), shift=x["e"] + x["by"] - x["k"])

    def limbs(x: Column) -> Column:
        own, other = _product(x["m"], F.greatest(-x["k"], F.lit(0)), F.greatest(x["shift"], F.lit(0))), _product(x["t"], F.greatest(x["k"], F.lit(0)), F.greatest(-x["shift"], F.lit(0)))
        return _let(compared, t=x["t"], k=x["k"], own=own, other=other)

    def compared(x: Column) -> Column:
        n = F.greatest(F.size(x["own"]), F.size(x["other"]))
        own, other = (F.reverse(F.concat(x[y], F.array_repeat(F.lit(0).cast("bigint"), n - F.size(x[y])))) for y in ("own", "other"))
        return _let(lambda y: _let(made, digits=y["digits"] + ((y["own"] > y["other"]) | ((y["own"] == y["other"]) & (y["digits"] % 2 == 1))).cast("bigint"), k=y["k"]), own=own, other=other, digits=F.floor(x["t"] / 10), k=x["k"] + 7)

    def made(x: Column) -> Column:
        full = x["digits"] == 10_000_000
        return _let(written, digits=F.when(full, F.lit("1000000")).otherwise(x["digits"].cast("string")), k=x["k"] + full.cast("int"))

    def written(x: Column) -> Column:
        power = F.lpad(F.abs(x["k"]).cast("string"), F.when(F.abs(x["k"]) < 100, 2).otherwise(3), F.lit("0"))
        return F.concat(F.substring(x["digits"], 1, 1), F.lit("."), F.substring(x["digits"], 2, 6), F.when(x["k"] < 0, F.lit("e-")).otherwise(F.lit("e+")), power)

    tie = F.substring(text, 9, 1).eqNullSafe("5") & (text.cast("double") == size)
    return F.when(tie, F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), _let(parts, size=size, text=text))).otherwise(F.format_string("%.6e", c))


def record(c: Column, dtype: T.DataType) -> Column:
    """c as the merge comparison writes it; null is empty for every type."""
    name, text = family(dtype), F.regexp_replace(c.cast("string") if not isinstance(dtype, T.BinaryType) else F.lit(""), _CONTROL, "")
    if name == "integer":
        out = c.cast("string")
    elif name == "decimal":
        out = _fixed(c.cast("double"), 4)
    elif name in ("float", "double"):
        size = F.abs(c.cast("double"))
        odd = (size > 1e10) | ((size > 0) & (size < 1e-10))
        out = F.when(odd, _scientific(c.cast("double"))).otherwise(_fixed(c.cast("double"), 6))
    elif name == "boolean":
        out = F.when(c, F.lit("1")).otherwise(F.lit("0"))
    elif name == "date":
        out = F.date_format(c, DATE)
    elif name in ("datetime", "timestamp"):
        out = F.date_format(c, SECOND)
    elif name == "time":
        out = F.regexp_extract(text, r"^(\d{2}:\d{2}:\d{2})", 1)
    elif name == "binary":
        out = F.lower(F.hex(c))
    else:
        out = text
    return F.when(c.isNull(), F.lit("")).otherwise(out)


def record_text(c: Column, name: str) -> Column:
    """As record, for text that holds a value of family name, as loosely typed sources give it; bad values take a default."""
    text = F.regexp_replace(c, _CONTROL, "")
    if name == "integer":
        out = F.coalesce(text.try_cast("bigint").cast("string"), F.lit("0"))
    elif name == "decimal":
        out = F.when(text.try_cast("double").isNull(), F.lit("0.0000")).otherwise(_fixed(text.try_cast("double"), 4))
    elif name in ("float", "double"):
        value = text.try_cast("double")
        out = F.when(value.isNull(), F.lit("0.000000")).otherwise(record(value, T.DoubleType()))
    elif name == "boolean":
        out = F.when(F.lower(text).isin("true", "1", "yes"), F.lit("1")).otherwise(F.lit("0"))
    elif name == "date":
        out = F.coalesce(F.date_format(F.substring(text, 1, 10).try_cast("date"), DATE), F.lit("1970-01-01"))
    elif name == "time":
        found = F.regexp_extract(text, r"^(\d{2}:\d{2}:\d{2})", 1)
        out = F.when(found == "", F.lit("00:00:00")).otherwise(found)
    elif name in ("datetime", "timestamp"):
        day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit(" 00:00:00")))
        full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), F.concat_ws(" ", F.substring(text, 1, 10), F.substring(text, 12, 8)))
        out = F.coalesce(day, full, text)
    else:
        out = text
    return F.when(c.isNull(), F.lit("")).otherwise(out)
