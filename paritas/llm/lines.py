"""Line deduplication over all documents, exact and within a few edits, in DataFrame operations only.

Every line that is not blank takes part. Of equal lines the first is kept, in order of doc_id and place; a line of LEAST bytes
or NEAR characters or more that is within EDITS edits of such a line that comes first earlier goes too, with all its copies.

Near lines are found by a segment-partition join: a line is cut into EDITS + 1 segments, one of which stands unedited in
any line within EDITS edits. Segments are indexed by length and number, and every line probes, for each length that a
partner can have, the few substrings where its segment can be. What meets is verified: common ends are taken off, and a
banded bit-parallel recurrence gives the edit distance of the rest. Lengths and edits are in characters.

Lines under a key that many share do not meet under it. They are cut again, into FINE segments of which all but EDITS stand
unedited, and meet under all such segments together, if they differ in the others. Where many share even these, as lines of
one template do, they meet under what is left of their other segments when up to EDITS characters are taken out, if that
gives fewer rows than pairs: a line's rows are bounded by its length, not by how many lines are like it.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import SPACES, cut, fresh, removed, sized, written

#: Bytes, or characters, of the shortest lines compared for edits: of sf0.1's lines of 16 to 31 characters 18 pairs are within
#: two edits, mostly of punctuation, of 12 to 15 there are 26, and of 8 to 11 there are 245, mostly of other words.
LEAST, NEAR, EDITS = 32, 16, 2
#: Lines that share a key beyond which they meet under finer ones; and the segments of these.
CROWD, FINE = 40, 8
#: Letters that are counted in pairs before these are verified.
LETTERS = "abcdefghijklmnopqrstuvwxyz ,."
#: Those of them whose numbers stand beside a line's keys, so that most other lines of a key do not become pairs at all.
FIRST = "ean"


def lines(docs: DataFrame) -> DataFrame:
    """(doc, row, no, line, h, g): the lines that are not blank, numbered from 0 in their document, which doc and a hash of its
    text name, with a hash of 128 bits.
    """
    # The hash and the parts first: what stands beside a generator is copied for each of its rows.
    known = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), F.split(F.col("text"), "\n").alias("parts"))
    rows = known.select("doc", "row", F.posexplode_outer("parts").alias("no", "line"))
    takes = (F.octet_length("line") >= LEAST) | (F.trim("line", F.lit(SPACES.decode())) != "")
    return rows.where(takes).select("doc", "row", "no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


# -- edit distance ----------------------------------------------------------------------------------------------------


def _common(a: Column, b: Column, most: Column, at_end: bool) -> Column:
    """Characters that a and b share at their start, or at their end, most at most; by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def part(s: Column, p: Column, step: Column) -> Column:
        return F.substring(s, F.length(s) - p - step + 1, step) if at_end else F.substring(s, p + 1, step)

    return F.aggregate(steps, F.lit(0), lambda p, step: F.when(p + step > most, p).when(part(a, p, step) == part(b, p, step), p + step).otherwise(p))


def within(pairs: DataFrame, a: str, b: str, edits: int = EDITS) -> DataFrame:
    """The pairs whose texts a and b are within edits edits of characters."""
    df = _once(pairs.where(F.abs(F.length(a) - F.length(b)) <= edits), _m=F.least(F.length(a), F.length(b)))
    df = _once(df, _head=_common(F.col(a), F.col(b), F.col("_m"), False))
    df = _once(df, _tail=_common(F.col(a), F.col(b), F.col("_m") - F.col("_head"), True))
    df = _once(df, **{name: F.substring(F.col(s), F.col("_head") + 1, F.length(s) - F.col("_head") - F.col("_tail")) for s, name in ((a, "_x"), (b, "_y"))})
    # An edit changes the number of one letter, or of two by one each: most other pairs go by these, before the recurrence.
    letters = F.array(*[F.lit(x) for x in LETTERS])
    df = df.where(F.aggregate(letters, F.lit(0), lambda n, x: n + F.abs(_number("_x", x) - _number("_y", x))) <= 2 * edits)
    width = 2 * edits + 1
    mask = (1 << width) - 1
    pad = F.array(*[F.lit("")] * edits)
    chars = lambda c: F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(F.col(c), ""))
    df = _once(df, _p=F.concat(pad, chars("_x"), pad, pad), _t=chars("_y"))
    start = F.struct(F.lit(0).alias("j"), F.lit(mask & ~((1 << edits) - 1)).alias("vp"), F.lit((1 << edits) - 1).alias("vn"), F.lit(edits).alias("d"))

    def column(state: Column, t: Column) -> Column:
        """One character of the text: the band's vertical differences move down a row with the diagonal."""
        j, vp, vn = state["j"], state["vp"], state["vn"]
        eq = F.lit(0)
        for k in range(width):
            eq = eq.bitwiseOR(F.when(F.get(F.col("_p"), j + k) == t, F.lit(1 << k)).otherwise(F.lit(0)))
        step = F.transform(F.array(eq), lambda e: F.struct(e.alias("e"), ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(mask)).alias("d0")))
        moved = F.transform(step, lambda s: _moved(s["d0"], j, vp, vn, state["d"], width, mask))
        # Beyond 3 edits of the band's lowest cell above the limit no cell of the band can come back to it.
        return F.when(state["d"] > 3 * edits, state).otherwise(F.get(moved, F.lit(0)))

    last = F.aggregate(F.col("_t"), start, column)
    df = _once(df, _s=last)
    # From the band's lowest cell of the last column up to the pattern's last row.
    m, n = F.length("_x"), F.length("_y")
    rows = F.lit((1 << (2 * edits)) - 1).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1, greatest(0, length(_x) - length(_y) + {edits})) - 1")))
    up = F.bit_count(F.col("_s.vp").bitwiseAND(rows)) - F.bit_count(F.col("_s.vn").bitwiseAND(rows))
    distance = F.when(F.greatest(m, n) <= edits, F.lit(0)).when(F.col("_s.d") > 3 * edits, F.lit(edits + 1)).otherwise(F.col("_s.d") - up)
    return df.where(distance <= edits).drop("_m", "_head", "_tail", "_x", "_y", "_p", "_t", "_s")


def _moved(d0: Column, j: Column, vp: Column, vn: Column, d: Column, width: int, mask: int) -> Column:
    hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask))
    hn, low = d0.bitwiseAND(vp), F.shiftright(d0, 1)
    return F.struct(
        (j + 1).alias("j"),
        hn.bitwiseOR(F.bitwise_not(low.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
        low.bitwiseAND(hp).alias("vn"),
        (d + 1 - F.shiftright(d0, width - 1)).alias("d"),
    )


def _number(c: str, x: str | Column) -> Column:
    """How often the letter x stands in column c."""
    return F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit(x) if isinstance(x, str) else x))


def counted(texts: DataFrame) -> DataFrame:
    """texts (line) with the numbers of its FIRST letters, each modulo 256, as one number: letters."""
    each = [_number("line", x).bitwiseAND(F.lit(255)) * F.lit(1 << 8 * i) for i, x in enumerate(FIRST)]
    return texts.withColumn("letters", sum(each[1:], each[0]))


def _apart(a: str, b: str) -> str:
    """SQL of how far the numbers of the FIRST letters of two lines are apart, at least, in all."""
    less = [f"pmod(shiftright({a}, {8 * i}) - shiftright({b}, {8 * i}), 256)" for i in range(len(FIRST))]
    return " + ".join(f"least({d}, 256 - {d})" for d in less)


# -- candidates -------------------------------------------------------------------------------------------------------


def _places(edits: int, delta: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings that a line probes for partners that are delta shorter; segments count from 1."""
    out = []
    for i in range(1, edits + 2):
        low, high = max(-(i - 1), delta - (edits + 1 - i)), min(i - 1, delta + (edits + 1 - i))
        out += [(i, s) for s in range(low, high + 1)]
    return out


def _bound(k: int, delta: int, edits: int) -> str:
    """The column that says where segment k of lines delta shorter ends, from 0; the ends of a line itself are known."""
    return "0" if k == 0 else f"n - {delta}" if k == edits + 1 else f"_{delta}_{k}"


def _key(i: int, shift: int, delta: int, edits: int) -> str:
    """SQL of the key of segment i of lines delta shorter than this one, b of length n, read at shift from its place
    there; null where the line has no such place.
    """
    start, stop = _bound(i - 1, delta, edits), _bound(i, delta, edits)
    made = f"xxhash64({i}, n - {delta}, substring(b, {start} + {1 + shift}, {stop} - {start}))"
    return made if shift == 0 else f"CASE WHEN {start} + {shift} >= 0 AND {stop} + {shift} <= n THEN {made} END"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator, through which the optimizer moves no expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def keyed(texts: DataFrame, edits: int, probes: bool) -> DataFrame:
    """(h, line, n, same, key): the length, and the keys of the indexed segments, or of the probes, of lines (h, line), one a row;
    same says whether a probe asks for lines of its own length. Other columns of texts stay.
    """
    deltas = range(edits + 1) if probes else (0,)
    keys = [f"struct({delta == 0} AS same, {_key(i, s, delta, edits)} AS key)" for delta in deltas for i, s in (_places(edits, delta) if probes else [(i, 0) for i in range(1, edits + 2)])]
    known = _once(texts, b=F.col("line"), n=F.length("line"))
    # Bounds first, so that the code made for the keys is short enough to be compiled; an outer generator makes each key once.
    known = _once(known, **{f"_{delta}_{k}": F.expr(f"int((n - {delta}) * {k} div {edits + 1})") for delta in deltas for k in range(1, edits + 1)})
    known = known.select(*texts.columns, "n", F.explode_outer(F.expr(f"array({', '.join(keys)})")).alias("at"))
    return known.select(*texts.columns, "n", "at.*").where("key is not null")


def _fine_shifts(masked: int, edits: int, delta: int) -> list[tuple[int, ...]]:
    """How far a line that is delta longer may have moved behind each of so many edited segments, the last time by delta."""
    moved = [(*s, delta) for s in itertools.product(range(-edits, edits + 1), repeat=masked - 1)]
    return [m for m in moved if sum(max(1, abs(b - a)) for a, b in zip((0, *m), m, strict=False)) <= edits]


def _fine_keys(masked: int, edits: int, probes: bool, of: int) -> str:
    """SQL of an array of (key, same, parts), one for each choice of so many masked segments and shifts: a hash of what stands
    between them in lines delta shorter, each run moved by the shift before it; whether lengths are equal; and the masked
    segments themselves, as they are under these shifts. Null where a segment does not fit.

    A choice is an array of the masked segments, counted from 0, then the shifts behind them; the last shift is delta.
    """
    shifts = [s for delta in range(edits + 1) for s in _fine_shifts(masked, edits, delta)] if probes else [(0,) * masked]
    choices = ", ".join(f"array({', '.join(map(str, (*m, *s)))})" for m in itertools.combinations(range(of), masked) for s in shifts)
    delta = f"c[{2 * masked - 1}]"
    runs, parts, fits, at, moved = [], [], [], "0", "0"
    for j in range(masked):
        start, stop, after = f"int((n - {delta}) * c[{j}] div {of})", f"int((n - {delta}) * (c[{j}] + 1) div {of})", f"c[{masked + j}]"
        runs.append(f"substring(b, {at} + 1 + {moved}, {start} - {at})")
        size = f"{stop} - {start} + {after} - {moved}"
        parts.append(f"substring(b, {start} + 1 + {moved}, {size})")
        fits.append(f"{size} >= 0")
        at, moved = stop, after
    runs.append(f"substring(b, {at} + 1 + {moved}, n - {at})")
    places = ", ".join(f"c[{j}]" for j in range(masked))
    made = f"struct(xxhash64({places}, n - {delta}, {', '.join(runs)}) AS key, {delta} = 0 AS same, array({', '.join(parts)}) AS parts)"
    return f"transform(array({choices}), c -> CASE WHEN {' AND '.join(fits)} THEN {made} END)"


def fine(texts: DataFrame, edits: int, probes: bool, of: int = FINE) -> DataFrame:
    """(h, key, same, parts): a row for each choice of up to edits segments in which a line's partner may differ from it, each
    of them edited at least once. Other columns of texts but line stay.
    """
    kept = [c for c in texts.columns if c != "line"]
    known = _once(texts, b=F.col("line"), n=F.length("line"))
    known = _once(known, keys=F.expr(f"concat({', '.join(_fine_keys(k, edits, probes, of) for k in range(1, edits + 1))})"))
    return known.select(*kept, F.explode("keys").alias("at")).where("at is not null").select(*kept, "at.*")


def _thinned(rest: Column, edits: int) -> Column:
    """rest, and all that is left when up to edits of its characters are taken out."""
    out = F.array(rest)
    for _ in range(edits):
        less = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.concat(F.array(s), less(s)))))
    return out


def candidates(texts: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """(a, b): hashes of the distinct lines (h, line) that share a key, each pair once or, from both its lines, twice.

    Lines of crowded keys meet each other under finer keys only, which find all their pairs; under the others they meet the rest.
    """
    texts = texts if "letters" in texts.columns else counted(texts)
    counts = keyed(texts.select("h", "line"), edits, False).groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.first("n").alias("n")).where(F.col("lines") > crowd)
    hot = sized(counts.select("key", "n"))
    # The lines of crowded keys; a line probes its own keys too. Their lengths leave out most others before keys are made.
    lengths = sized(hot.select(F.explode(F.sequence(F.col("n"), F.col("n") + edits)).alias("length")).distinct())
    near = texts.join(lengths, F.length("line") == F.col("length"), "left_semi")
    crowded = cut(keyed(near, edits, True).join(hot.select("key"), "key", "left_semi").select("h", "line", "letters").dropDuplicates(["h"]))
    flagged = texts.join(sized(crowded.select("h", F.lit(True).alias("dense"))), "h", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    found = _met(*[keyed(flagged, edits, probes).drop("line", "n").join(hot.select("key"), "key", "left_anti") for probes in (False, True)], edits)
    index = fine(crowded, edits, False)
    many = index.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > crowd)
    # Under a fine key that many lines share: the usual segments, which are the median's if over half of the lines have them,
    # and whether taking characters out makes fewer rows than there are lines.
    usual = [F.percentile_approx(F.xxhash64(F.get("parts", F.lit(j))), 0.5) for j in range(edits)]
    width = F.max(F.length(F.array_join("parts", "\n"))).cast("double")
    rows = sum((F.pow(width, F.lit(k)) / math.factorial(k) for k in range(1, edits + 1)), F.lit(1.0))
    again = sized(index.join(sized(many), "key").groupBy("key").agg(F.array(*usual).alias("usual"), (rows < F.first("lines")).alias("thin")), 128)

    def finer(probes: bool) -> DataFrame:
        """The segments of two lines that are edited are not both the usual ones: keys name those that are unusual in the
        indexed line, and a line asks for all that, with its own, make up every masked segment.
        """
        known = fine(crowded, edits, probes).join(again, "key", "left")
        bits = F.array(*[F.lit(1 << j) for j in range(edits)])
        odd = F.transform("parts", lambda x, j: F.when(F.xxhash64(x) != F.get("usual", j), F.get(bits, j)).otherwise(0))
        every = F.get(F.array(*[F.lit((2 << j) - 1) for j in range(edits)]), F.size("parts") - 1)
        known = _once(known, odd=F.when(F.col("usual").isNotNull(), F.aggregate(odd, F.lit(0), lambda a, b: a + b)), every=every)
        wanted = F.filter(F.sequence(F.lit(0), F.col("every")), lambda f: f.bitwiseOR(F.col("odd")) == F.col("every")) if probes else F.array("odd")
        left = F.when(F.col("thin"), _thinned(F.array_join("parts", "\n"), edits)).otherwise(F.array(F.lit("")))
        known = _once(known, wanted=wanted, left=left)
        keys = F.flatten(F.transform("wanted", lambda f: F.transform("left", lambda s: F.xxhash64("key", f, s))))
        return known.select("h", "letters", "same", F.explode(F.when(F.col("usual").isNull(), F.array("key")).otherwise(keys)).alias("key"))

    return found.unionByName(_met(finer(False), finer(True), edits)).distinct()


def _met(index: DataFrame, probes: DataFrame, edits: int) -> DataFrame:
    """(a, b) of the probes (h, letters, same, key) and the indexed rows (h, letters, key) that share a key, but for those whose
    letters are too many edits apart; lines that ask for each other, once, and dense ones, where both sides say which these
    are, not with each other.
    """
    dense = ["dense"] if "dense" in index.columns else []
    side = index.select(F.col("key").alias("k"), F.col("h").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("letters", *dense)])
    both = side.join(probes.select("key", "same", F.col("h").alias("a"), "letters", *dense), F.col("k") == F.col("key"))
    # An edit changes the number of one letter, or of two by one each.
    takes = ["a <> b", "(not same or a < b)", *(f"not (dense and b_{c})" for c in dense), f"{_apart('letters', 'b_letters')} <= {2 * edits}"]
    return both.where(" and ".join(takes)).select("a", "b")


# -- documents --------------------------------------------------------------------------------------------------------


def removals(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc, row, gone, links): places of the lines that go, for each document that loses some; links counts those that go as near."""
    place = F.struct("doc", "row", "no")
    named = cut(lines(docs).select("doc", "row", "no", "h", "g"))
    whole = named.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = sized(whole.where("n > 1").select("h", "g", "first"), 96)
    again = ~place.eqNullSafe(F.col("first"))
    long = lines(docs).where((F.octet_length("line") >= LEAST) | (F.length("line") >= NEAR))
    texts = long.join(repeated, ["h", "g"], "left").where(F.col("first").isNull() | ~again)
    # Read five times; as Parquet, a line's text is on disk once more, compressed.
    texts, path = written(counted(texts).select("h", "g", "line", "letters", place.alias("at")), "lines")
    pairs = cut(candidates(texts.select("h", "line", "letters"), edits))
    wanted = sized(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct())
    held = cut(texts.drop("letters").join(wanted, "h", "left_semi"))
    removed(texts.sparkSession, path)
    side = lambda s: held.select(*[F.col(c).alias(f"{s}_{c}") for c in held.columns])
    both = pairs.join(side("x"), F.col("a") == F.col("x_h")).join(side("y"), F.col("b") == F.col("y_h"))
    near = within(both, "x_line", "y_line", edits)
    later = lambda s: F.when(F.col("x_at") > F.col("y_at"), F.col(f"x_{s}")).otherwise(F.col(f"y_{s}"))
    late = sized(near.select(later("h").alias("h"), later("g").alias("g")).distinct().withColumn("near", F.lit(True)))
    marked = named.join(repeated, ["h", "g"], "left").join(late, ["h", "g"], "left")
    goes = marked.where(F.col("near") | (F.col("first").isNotNull() & again))
    return goes.groupBy("doc", "row").agg(F.sort_array(F.collect_set("no")).alias("gone"), F.count_if(F.col("near")).alias("links"))


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs with their text without the lines that go, and n_lines, n_removed and n_near (those of them near another line).

    A null text stays null, with no lines; an empty one has one empty line. Rows of one doc_id are documents of their own if
    their texts differ; rows that repeat both count as one, whose lines go or stay together. Rows without a doc_id come first
    in the order. An empty table gives no rows. Columns n_lines, n_removed and n_near of docs are replaced; others stay,
    whatever their names.
    """
    base = docs.drop("n_lines", "n_removed", "n_near")
    doc, row, gone, links, parts, kept = (fresh(x, base.columns) for x in ("doc", "row", "gone", "links", "parts", "kept"))
    found = sized(removals(docs.select("doc_id", "text"), edits), F.size("gone") * 4 + 96).toDF(doc, row, gone, links)
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left")
    n = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    made = _once(both, **{parts: F.when(F.col("text").isNotNull(), F.split(F.col("text"), "\n"))})
    # Places that stay, by a hash set, so that a document's cost grows with its lines alone.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n"))
    made = made.withColumn(kept, text)
    columns = [F.col(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns]
    return made.select(*columns, n.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.col(links), F.lit(0)).cast("long").alias("n_near"))
