r"""Operator 9, line dedup by a segment-partition edit join, in SQL functions only.

Every line with a character is compared for equality, over the whole corpus.
Lines of ``min_chars`` characters or more also join by edit distance: two lines
are linked within one edit for each ``rate`` characters of the shorter one, one
at least and ``most`` at most.

The join.  Lengths are cut into classes of ``rate``; a class has one number of
edits e and one base, its least length.  An indexed line has e + 1 segments of
base / (e + 1) characters, half of them counted from the line's start and half
from its end, so that one key serves all lengths of a class.  One segment
survives in any linked line that isn't shorter, moved by no more than its rank
from its end of the line; a line therefore probes with 2 r + 1 substrings for
the segment of rank r, in its own class and in a class below that is near
enough.  Keys that two lines share are found by an aggregate of two numbers
with map-side combine, and only lines with such a key are read again.
Candidates are verified on whole lines by banded bit-parallel edit distance.

Sketches.  A line's sketch has two bits for each of ``LETTERS`` characters: how
often the line has it, modulo 4, in Gray code.  An edit moves two counts by one
at most, one that changes the length moves one, and a step of a count flips one
bit: linked lines' sketches differ in 2 e bits at most, less the difference in
length.  Lines that share a key make a pair only then; which characters are
counted decides how many pairs are verified, never which lines are linked.

Crowds.  A key that more than ``CROWD`` lines share makes no pairs of them at
first.  All its lines are verified against the one whose sketch is nearest to
the middle of theirs; a crowd whose lines are then in one class is done.  Up to ``PAIRED`` lines, those of different classes
then make pairs by their sketches.  In larger crowds lines meet by exact length too, the shared segment
is cut out, and where that leaves a crowd the rest is cut into ``WINDOWS`` windows: e edits lie in e of them at most, so linked lines
share all of the rest but those windows, a longer key.  Windows are cut again
while there are such crowds with lines of two classes.  Only the plan depends on
``CROWD`` and ``PAIRED``: classes are those of all linked pairs.

Links join lines into classes; of a class the first line stays, by doc_id, then
hash of the text, then place.  ``n_links`` counts the other different lines of
the class, those that links reach.

Null texts and empty lines are left alone.  Rows with one doc_id count as one
document with several texts; identical rows are cleaned alike.  A null doc_id
comes after all others.  An empty table gives no rows.  Very long lines and
texts are treated like any other.  Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_few, let, materialize
from tessera.llm.components import connected

#: Characters of the shorter line for each edit; also the width of a class of lengths.
RATE = 32
MOST = 4
#: Shorter lines are compared for equality only.
MIN_CHARS = 20
#: More lines than this with one key are a crowd.
CROWD = 16
#: Lines of a crowd that are compared by their sketches; a larger crowd is cut.
PAIRED = 2000
#: Characters that a sketch counts, two bits each.
LETTERS = 32
#: Windows into which a crowd's lines are cut.
WINDOWS = 6
_LAST = (1 << 63) - 1
_SIGN = -(1 << 63)


def line_hashes(line: Column) -> list[Column]:
    """128 bits that stand for a line; the first half is its id in the join."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, place, line`` for each line that isn't empty."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")  # once a text, not once a line
    lines = hashed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where(F.col("line") != "")


def _first() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"), "text_hash", "place")


# ---------------------------------------------------------------- lengths and segments

def base_of(chars: Column, rate: int, min_chars: int) -> Column:
    """The least length of a length's class."""
    return F.greatest(F.lit(min_chars), (chars - chars % rate)).cast("int")


def errors_of(base: Column, rate: int, most: int) -> Column:
    """Edits within which the lines of a class are linked to lines that aren't shorter."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(base / rate))).cast("int")


def probes(errors: int) -> list[tuple[int, int, int]]:
    """Segment number, rank from its end of the line, and shift; numbers below half of the segments count from the start.

    Multi-match-aware bounds: before a surviving segment of rank r lie r
    segments that don't, behind it errors - r; it moves by r edits at most,
    seen from the nearer end, whatever the difference in length.
    """
    half = (errors + 2) // 2
    ranked = [(k, k if k < half else errors - k) for k in range(errors + 1)]
    return [(k, r, s) for k, r in ranked for s in range(-r, r + 1)]


def _start() -> Column:
    """Start (from 1) of a probe ``p``'s substring; ``seg`` is the segments' length."""
    front = 1 + F.col("p.shift") + F.col("p.rank") * F.col("seg")
    return F.when(F.col("p.front"), front).otherwise(F.col("chars") - (F.col("p.rank") + 1) * F.col("seg") + 1 - F.col("p.shift"))


def _top_rows(docs: DataFrame, rate: int, most: int, min_chars: int) -> DataFrame:
    """``id, line, chars, base, errors, own, grp``: each long enough line in its class, and as a probe in classes below that reach it."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select("line", F.char_length("line").alias("chars")).where(F.col("chars") >= min_chars)
    own_base = base_of(F.col("chars"), rate, min_chars)

    def below(delta: int) -> Column:
        base = base_of(F.col("chars") - delta, rate, min_chars)
        reached = (F.col("chars") - delta >= min_chars) & (base != own_base) & (errors_of(base, rate, most) >= delta)
        return F.when(reached, F.struct(base.alias("base"), F.lit(False).alias("own")))

    roles = F.array(F.struct(own_base.alias("base"), F.lit(True).alias("own")), *[below(d) for d in range(1, most + 1)])
    near_edge = F.col("chars") - own_base < most
    roles = F.when(near_edge, F.filter(F.array_distinct(roles), lambda r: r.isNotNull())).otherwise(F.slice(roles, 1, 1))
    rows = lines.select(F.xxhash64("line").alias("id"), "line", "chars", F.explode(roles).alias("r"))
    return rows.select("id", "line", "chars", "r.base", errors_of(F.col("r.base"), rate, most).alias("errors"), "r.own", F.col("r.base").cast("long").alias("grp"))


def _segmented(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seg", F.floor(F.col("base") / (F.col("errors") + 1)).cast("int"))


def _by_errors(most: int, value: Callable[[int], Column]) -> Column:
    """The value for the row's number of edits."""
    out = F
    for e in range(1, most + 1):
        out = out.when(F.col("errors") == e, value(e))
    return out


def _mark(own: Column) -> Column:
    """The id, with the sign bit set for an own segment of an indexed line."""
    return F.when(own, F.col("id").bitwiseOR(F.lit(_SIGN))).otherwise(F.col("id").bitwiseAND(F.lit(_LAST)))


def _ordered(errors: int) -> list[tuple[int, int, int]]:
    """The probes, own segments first."""
    return sorted(probes(errors), key=lambda p: p[2] != 0)


def _exploded(rows: DataFrame, most: int) -> DataFrame:
    """``key, id, mark, start, seg, chars, base, errors`` for every segment and probe of every row."""

    def probe(at: int, e: int, k: int, r: int, s: int) -> Column:
        return F.struct(F.lit(at <= e).alias("own"), F.lit(k).alias("number"), F.lit(r).alias("rank"), F.lit(s).alias("shift"), F.lit(k < (e + 2) // 2).alias("front"))

    # constants are exploded, and keys computed of them then: an expression inside explode isn't compiled
    numbered = _by_errors(most, lambda e: F.array(*[probe(at, e, *p) for at, p in enumerate(_ordered(e))]))
    # four bytes a character: a part is found at once, where UTF-8 is counted through twice for each probe
    wide = _segmented(rows).withColumn("wide", F.encode("line", "UTF-32")).drop("line")
    exploded = wide.withColumn("p", F.explode(numbered)).withColumn("start", _start())
    key = F.xxhash64("grp", F.col("p.number"), F.substring(F.col("wide"), 4 * F.col("start") - 3, 4 * F.col("seg")))
    return exploded.select(key.alias("key"), "id", _mark(F.col("own") & F.col("p.own")).alias("mark"), "start", "seg", "chars", "base", "errors")


def _shared_keys(rows: DataFrame, most: int) -> DataFrame:
    """Keys that an indexed line has as its own and another line has too: two numbers a key, combined before the shuffle."""
    return _met_keys(_exploded(rows, most).select("key", "mark"))


def _met_keys(marked: DataFrame) -> DataFrame:
    least = marked.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    return materialize(least.where("low < 0 and low <> high").select("key"), "shared-keys")


def _members(rows: DataFrame, most: int, shared: DataFrame) -> DataFrame:
    """``key, id, mark, start, seg, chars, base, errors``: the rows with a shared key."""
    met = join_few(_exploded(rows, most), shared, "key", "left_semi")
    # a hot line has its keys in every document that has it: combined before the shuffle
    return materialize(met.dropDuplicates(["key", "mark", "start"]), "members")


# ---------------------------------------------------------------- verification

#: Columns after which a verification looks whether it can still succeed.
BLOCK = 24


def _same_ends(x: Column, y: Column) -> Column:
    """Number of first characters that both texts have, by bisection; ``x`` mustn't be longer."""
    size = F.char_length(x)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = lambda k: F.substring(x, F.lit(1), k) == F.substring(y, F.lit(1), k)
        agree = lambda k: F.struct(k.alias("low"), s["high"].alias("high"))
        differ = lambda k: F.struct(s["low"].alias("low"), (k - 1).alias("high"))
        return F.when(s["low"] >= s["high"], s).otherwise(let(mid, lambda k: F.when(same(k), agree(k)).otherwise(differ(k))))

    steps = F.length(F.bin(size.cast("long")))
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda s: s["low"])


def edit_distance(x: Column, y: Column, most: int) -> Column:
    """Edit distance where it is ``most`` or less, else a greater number: bit vectors of a band of 2 most + 1 diagonals in a long.

    ``x`` mustn't be longer than ``y``.  What both begin with is skipped.  Then,
    column by column of ``y``, bit b stands for the row j - most + b of ``x``.
    The distance is followed down the main diagonal to the last row, then along
    that row.  A pair that is beyond its budget after a block goes no further.
    """
    if 2 * most + 1 > 62:
        raise ValueError("the band must fit a long")
    far = F.char_length(y) - F.char_length(x) > most

    def rest(skip: Column) -> Column:
        cut = lambda t: F.substring(t, skip + 1, F.char_length(t))
        return let(F.struct(cut(x).alias("x"), cut(y).alias("y")), lambda p: _banded(p["x"], p["y"], most))

    return F.when(far, F.lit(most + 1).cast("long")).otherwise(let(_same_ends(x, y), rest))


def _banded(x: Column, y: Column, most: int) -> Column:
    mask = F.lit((1 << (2 * most + 1)) - 1).cast("long")
    flip = lambda v: F.bitwise_not(v).bitwiseAND(mask)
    bit = lambda v, b: F.call_function("shiftright", v, b).bitwiseAND(F.lit(1).cast("long"))
    m, n = F.char_length(x), F.char_length(y)
    # down the diagonal the distance never falls, and along the last row by n - m at most
    lost = lambda s: s["dist"] > most + s["slack"]

    def columns(xs: Column, ys: Column, first: Column, last: Column, state: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            def with_matches(eq: Column) -> Column:
                d0 = ((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(mask)

                def with_d0(d: Column) -> Column:
                    def with_hp(hp: Column) -> Column:
                        hn, moved, row = d.bitwiseAND(s["vp"]), F.shiftrightunsigned(d, 1), s["rows"] - j + most
                        return F.struct(
                            hn.bitwiseOR(flip(moved.bitwiseOR(hp))).alias("vp"),
                            moved.bitwiseAND(hp).alias("vn"),
                            (s["dist"] + F.when(j <= s["rows"], F.lit(1).cast("long") - bit(d, F.lit(most))).otherwise(bit(hp, row) - bit(hn, row))).alias("dist"),
                            s["rows"].alias("rows"),
                            s["slack"].alias("slack"),
                        )

                    return let(s["vn"].bitwiseOR(flip(d.bitwiseOR(s["vp"]))), with_hp)

                return let(d0, with_d0)

            y_j = F.get(ys, j - 1)
            same = [F.when(F.get(xs, j - most + b - 1) == y_j, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(2 * most + 1)]
            total = same[0]
            for v in same[1:]:
                total = total + v
            return F.when(lost(s), s).otherwise(let(total, with_matches))

        return F.aggregate(F.sequence(first, last), state, step)

    def with_ends(chars: Callable[[Column], Column], first: Column, last: Column, state: Column) -> Column:
        return let(F.struct(chars(x).alias("x"), chars(y).alias("y")), lambda p: columns(p["x"], p["y"], first, last, state))

    # in the column before the first each row is one more than the row above
    start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).cast("long").alias("dist"), m.alias("rows"), (n - m).alias("slack"))
    begin = with_ends(lambda t: F.split(F.substring(t, 1, BLOCK + most), ""), F.lit(1), F.least(n, F.lit(BLOCK)), start)
    whole = lambda s: with_ends(lambda t: F.split(t, ""), F.lit(BLOCK + 1), n, s)["dist"]
    found = let(begin, lambda s: F.when(lost(s) | (n <= BLOCK), s["dist"]).otherwise(whole(s)))
    return F.when(m == 0, n.cast("long")).otherwise(found)


def _verified(pairs: DataFrame, texts: DataFrame, rate: int, most: int, min_chars: int) -> DataFrame:
    """``a, b, na, nb``: the pairs of ids that are linked, with the lines' full names."""
    side = lambda i: texts.select(F.col("id").alias(i), F.col("node").alias(f"n{i}"), F.col("line").alias(f"l{i}"), F.col("chars").alias(f"c{i}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("na <> nb")
    swap = F.col("ca") > F.col("cb")
    short, long_ = F.when(swap, F.col("lb")).otherwise(F.col("la")), F.when(swap, F.col("la")).otherwise(F.col("lb"))
    base = base_of(F.least("ca", "cb"), rate, min_chars)
    met = met.select("a", "b", "na", "nb", short.alias("x"), long_.alias("y"), errors_of(base, rate, most).alias("errors"))
    met = met.where(F.char_length("y") - F.char_length("x") <= F.col("errors"))
    return materialize(met.where(edit_distance(F.col("x"), F.col("y"), most) <= F.col("errors")).select("a", "b", "na", "nb"), "edit-links")


# ---------------------------------------------------------------- sketches

def _letters(texts: DataFrame) -> list[str]:
    """Frequent characters of some lines; any others would do, with more pairs to verify."""
    chars = texts.select(F.substring("line", 1, 400).alias("line")).limit(500).select(F.explode(F.split("line", "")).alias("c"))
    rows = chars.where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS).collect()
    return [r["c"] for r in rows]


def sketch(line: Column, letters: list[str]) -> Column:
    """Two bits for each letter: its count modulo 4 in Gray code, so that one more or less flips one bit."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(letters):
        count = F.floor((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) / len(c.encode())).cast("long").bitwiseAND(F.lit(3).cast("long"))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseXOR(F.shiftright(count, 1)), 2 * k))
    return out


def _alike(x: str, y: str, longer: Column) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 2 * F.col("errors") - longer


def _central(crowded: DataFrame) -> DataFrame:
    """``key, rep``: of each crowd the indexed line whose sketch is nearest to the middle one, which has the bits that most lines have.

    Copies of one line differ from each other in twice as many edits as from
    that line: verified against it, most of them are in its class at once.
    """
    own = crowded.where("mark < 0")
    bit = lambda k: F.shiftright("sketch", k).bitwiseAND(F.lit(1).cast("long"))
    counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(bit(k)).alias(f"b{k}") for k in range(2 * LETTERS)])
    bits = [F.shiftleft((2 * F.col(f"b{k}") > F.col("n")).cast("long"), k) for k in range(2 * LETTERS)]
    middle = materialize(counts.select("key", reduce(Column.bitwiseOR, bits).alias("middle")), "middles")
    away = F.bit_count(F.col("sketch").bitwiseXOR(F.col("middle"))).alias("away")
    return materialize(join_few(own, middle, "key", "inner").groupBy("key").agg(F.min(F.struct(away, "id", "comp", "sketch", "chars")).alias("rep")), "central")


# ---------------------------------------------------------------- the join

def edit_links(docs: DataFrame, rate: int = RATE, most: int = MOST, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Links ``na, nb`` that span the classes of linked lines, and ``id, node, line, chars, first, n`` of lines with a shared key."""
    if rate < 2 or min_chars < 2:
        raise ValueError("a line needs a character for each segment: rate and min_chars must be 2 or more")
    top = _top_rows(docs, rate, most, min_chars)
    members = _members(top, most, _shared_keys(top, most))
    ids = materialize(members.select("id").distinct(), "ids")
    lines = occurrences(docs).where(F.char_length("line") >= min_chars).withColumn("id", F.xxhash64("line"))
    told = join_few(lines, ids, "id", "left_semi").groupBy("id", "line").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
    node = F.concat(F.hex("id"), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "line")))
    texts = materialize(told.select("id", node.alias("node"), "line", F.char_length("line").alias("chars"), "first", "n"), "texts")
    verified = lambda pairs: _verified(materialize(pairs.distinct(), "pairs"), texts, rate, most, min_chars)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def meeting(rows: DataFrame) -> DataFrame:
        """Pairs of lines of different classes with a key, near lengths and near sketches."""
        index = rows.where("mark < 0").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("chars").alias("lx"), F.col("sketch").alias("sx"))
        other = rows.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("chars").alias("ly"), F.col("sketch").alias("sy"), "mark", "errors")
        # two indexed lines meet once, not once from each side
        near = F.expr("x <> y and (mark >= 0 or x < y) and cx <> cy and abs(lx - ly) <= errors") & _alike("sx", "sy", F.abs(F.col("lx") - F.col("ly")))
        return index.join(other, (index["key"] == other["key"]) & near).select(*pair("x", "y"))

    sketches = texts.select("id", sketch(F.col("line"), _letters(texts)).alias("sketch"))
    members, links, ends = materialize(members.join(sketches, "id"), "sketched").withColumn("comp", F.col("id")), None, None
    while True:
        crowds = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWD), "crowds")
        small = join_few(members, crowds.select("key"), "key", "left_anti")
        crowded = materialize(join_few(members, crowds, "key", "inner"), "crowded")
        crowded = join_few(crowded, _central(crowded), "key", "inner")
        star = crowded.where(F.expr("id <> rep.id and comp <> rep.comp") & _alike("sketch", "rep.sketch", F.abs(F.col("chars") - F.col("rep.chars")))).select(*pair("id", "rep.id"))
        near = meeting(small)
        found = verified(near.unionAll(star) if ends is None else near.unionAll(star).unionAll(ends))
        links = found if links is None else links.unionAll(found)
        if crowds.head() is None:
            break
        roots = connected(links.select("a", "b")).select(F.col("node").alias("id"), "root")
        known = crowded.drop("rep").join(roots, "id", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        parted = known.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("key")
        known = materialize(join_few(known, materialize(parted, "parted"), "key", "left_semi"), "parted-crowds")
        if known.head() is None:
            break
        links = links.unionAll(verified(meeting(known.where(F.col("rows") <= PAIRED))))
        known = known.where(F.col("rows") > PAIRED).drop("rows")
        if known.head() is None:
            break
        if "start" in known.columns:
            rows, ends = materialize(_cut(known.join(texts.select("id", "line"), "id")), "cut"), None
        else:
            # lines with nothing left to cut: those of one length are linked by now, the longer ones are tried
            last, rows = known.where("base <= errors"), _windowed(known.where("base > errors"), most)
            index = last.where("mark < 0").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"))
            tried = index.join(last.where("mark >= 0").select("key", F.col("id").alias("y"), F.col("comp").alias("cy")), "key")
            ends = tried.where("cx <> cy").select(*pair("x", "y"))
        members = materialize(join_few(rows, _met_keys(rows.select("key", "mark")), "key", "left_semi").dropDuplicates(["key", "mark", "line"]), "members")
    return links.select("na", "nb"), texts


def _cut(crowded: DataFrame) -> DataFrame:
    """The lines of crowds without the shared segment, for each length that they index or probe.

    Lengths are exact now: a line is indexed by its own, and probes those less
    by the edits that are left in its crowd.
    """
    before = F.substring(F.col("line"), F.lit(1), F.col("start") - 1)
    after = F.substring(F.col("line"), F.col("start") + F.col("seg"), F.col("chars"))
    left = crowded.withColumn("least", F.col("base") - F.col("seg")).withColumn("line", F.concat(before, after)).withColumn("chars", F.char_length("line"))
    deltas = F.sequence(F.lit(0), F.least("errors", F.col("chars") - F.col("least")))
    rows = left.where("chars >= least").withColumn("delta", F.explode(deltas)).withColumn("base", (F.col("chars") - F.col("delta")).cast("int"))
    mark = _mark((F.col("mark") < 0) & (F.col("delta") == 0))
    return rows.select(F.xxhash64("key", "base").alias("key"), "id", mark.alias("mark"), "comp", "sketch", "errors", "base", "chars", "line")


def dirty_windows(errors: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Choices of as many of ``WINDOWS`` windows as there are edits, and shifts of the parts between them.

    Two edits in one window also leave out a window beside it, so that k edits
    lie before the part that follows the k-th window, and errors - k behind.
    """
    out = []
    for t in combinations(range(WINDOWS), errors):
        ranges = [(0,) if a + 1 == b else range(-k, k + 1) for k, (a, b) in enumerate(zip(t, t[1:]), 1)]
        out += [(t, (0, *s)) for s in product(*ranges)]
    return out


def _windowed(rows: DataFrame, most: int) -> DataFrame:
    """``key, id, mark, comp, sketch, errors, base, chars, line``: what all edits leave of a line, as key, and the rest of the line.

    The indexed line is cut into ``WINDOWS`` windows, at most ``errors`` of them
    with edits; the parts before, between and after are the same in a linked
    line, at a shift.
    """
    delta = F.col("chars") - F.col("base")

    def choices(e: int) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("n"), F.array(*map(F.lit, t)).alias("t"), F.array(*map(F.lit, s)).alias("s")) for n, (t, s) in enumerate(dirty_windows(e))])

    def parts(e: int) -> Column:
        edge = lambda w: F.floor(F.col("base") * w / WINDOWS).cast("int")

        def one(c: Column) -> Column:
            shift = [*[F.get(c["s"], k) for k in range(e)], delta]
            stop = [edge(F.get(c["t"], k)) + shift[k] for k in range(e)] + [F.col("chars")]
            start = [F.lit(0)] + [edge(F.get(c["t"], k - 1) + 1) + shift[k] for k in range(1, e + 1)]
            fits = reduce(lambda a, b: a & b, [(start[k] >= stop[k - 1]) for k in range(1, e + 1)] + [(F.abs(shift[k] - delta) <= e - k) | (start[k] >= stop[k]) for k in range(1, e)], F.lit(True))
            key = F.xxhash64("key", F.array_join(c["t"], ","), *[F.substring(F.col("line"), start[k] + 1, F.greatest(F.lit(0), stop[k] - start[k])) for k in range(e + 1)])
            rest = F.concat(*[F.substring(F.col("line"), stop[k] + 1, start[k + 1] - stop[k]) for k in range(e)])
            mine = (F.col("mark") < 0) & F.forall(c["s"], lambda x: x == 0)
            return F.when(fits, F.struct(key.alias("key"), rest.alias("line"), mine.alias("mine")))

        return F.transform(choices(e), one)

    exploded = rows.select("id", "comp", "sketch", "errors", delta.alias("delta"), F.explode(_by_errors(most, parts)).alias("k")).where("k is not null")
    chars = F.char_length("k.line")
    return exploded.select("k.key", "id", _mark(F.col("k.mine")).alias("mark"), "comp", "sketch", "errors", (chars - F.col("delta")).cast("int").alias("base"), chars.alias("chars"), "k.line")


# ---------------------------------------------------------------- classes and documents

def line_classes(docs: DataFrame, rate: int = RATE, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, class_id, first, line_first, n_lines``: the lines that are equal or near to another.

    ``first`` is where the class's first line is, ``line_first`` the line's own
    first place, ``n_lines`` the number of different lines in the class.
    """
    links, texts = edit_links(docs, rate, most, min_chars)
    roots = connected(links, "na", "nb")
    equal = occurrences(docs).select(*line_hashes(F.col("line")), _first().alias("first")).groupBy("h1", "h2").agg(F.min("first").alias("line_first"), F.count(F.lit(1)).alias("n"))
    equal = equal.where("n > 1").select("h1", "h2", "line_first")
    linked = texts.join(roots, "node").select(*line_hashes(F.col("line")), "root", F.col("first").alias("line_first"))
    both = equal.select("*", F.lit(None).cast("string").alias("root")).unionByName(linked)
    name = F.concat(F.hex("h1"), F.lit("-"), F.hex("h2"))
    lines = both.groupBy("h1", "h2").agg(F.min("line_first").alias("line_first"), F.max("root").alias("root"))
    lines = materialize(lines.select("h1", "h2", "line_first", F.coalesce("root", name).alias("class_id"), F.col("root").isNotNull().alias("linked")), "repeated")
    classes = lines.where("linked").groupBy("class_id").agg(F.min("line_first").alias("first"), F.count(F.lit(1)).alias("n_lines"))
    met = lines.join(classes, "class_id", "left")
    return materialize(met.select("h1", "h2", "class_id", F.coalesce("first", "line_first").alias("first"), "line_first", F.coalesce("n_lines", F.lit(1)).alias("n_lines")), "line-classes")


def _of_classes(docs: DataFrame, *args: int) -> DataFrame:
    """The occurrences of lines that are in a class, and whether they stay."""
    found = occurrences(docs).select("doc_id", "text_hash", "place", *line_hashes(F.col("line")))
    met = join_few(found, line_classes(docs, *args), ["h1", "h2"], "inner")
    return met.withColumn("stays", _first() == F.col("first"))


def _kept_doc() -> Column:
    return F.when(F.col("first.doc") != _LAST, F.col("first.doc"))


def members(docs: DataFrame, rate: int = RATE, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, place, class_id, kept_doc, kept_place, n_links, stays``: each line that is in a class, and where the class's first line is.

    ``kept_doc`` is null where no document with an id has one.
    """
    met = _of_classes(docs.select("doc_id", "text"), rate, most, min_chars)
    return met.select("doc_id", "place", "class_id", _kept_doc().alias("kept_doc"), F.col("first.place").alias("kept_place"), (F.col("n_lines") - 1).alias("n_links"), "stays")


def removals(docs: DataFrame, rate: int = RATE, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, removed, near, n_links, first_doc, classes`` for each text with lines of a class.

    ``removed``: places of lines; ``near``: places of those that differ from the
    class's first; ``n_links``: the other different lines in its lines' classes;
    ``first_doc``: the least document that keeps one of the removed lines;
    ``classes``: where each class's first line is, as ``doc_id:place``.
    """
    met = _of_classes(docs, rate, most, min_chars)
    named = F.concat_ws(":", F.coalesce(_kept_doc().cast("string"), F.lit("")), "first.place")
    # identical rows count once
    once = met.dropDuplicates(["doc_id", "text_hash", "place"])
    return once.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.when(~F.col("stays"), F.col("place"))).alias("removed"),
        F.count_if(~F.col("stays") & (F.col("line_first") != F.col("first"))).alias("near"),
        F.sum(F.col("n_lines") - 1).alias("n_links"),
        F.min(F.when(~F.col("stays"), _kept_doc())).alias("first_doc"),
        F.array_join(F.sort_array(F.collect_set(named)), ",").alias("classes"),
    )


def _joined(docs: DataFrame, *args: int) -> DataFrame:
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = own.select("row", F.col("row.doc_id").alias("_id"), F.xxhash64("row.text").alias("_hash"))
    gone = removals(docs.select("doc_id", "text"), *args)
    met = keyed.join(gone.hint("shuffle_hash"), keyed["_id"].eqNullSafe(gone["doc_id"]) & (keyed["_hash"] == gone["text_hash"]), "left")
    lines = F.split("row.text", "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.array_contains("removed", i), F.lit(False))), "\n")
    return met.withColumn("cleaned", F.when(F.size("removed") > 0, left).otherwise(F.col("row.text")))


def deduplicated(docs: DataFrame, rate: int = RATE, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without repeated lines; a text may become empty, no row is lost, n_chars (if there) follows the text."""
    met = _joined(docs, rate, most, min_chars)
    swap = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        chars = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
        swap["n_chars"] = F.coalesce(chars, F.col("row.n_chars"))
    return met.select(*[swap.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, rate: int = RATE, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document: its lines, those removed, its lines' classes and links, and the cleaned text's hash."""
    met = _joined(docs.select("doc_id", "text"), rate, most, min_chars)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return met.select(
        F.col("_id").alias("doc_id"),
        F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        count(F.greatest(F.lit(0), F.size("removed"))).alias("n_removed"),
        count(F.col("near")).alias("n_removed_near"),
        count(F.col("n_links")).alias("n_links"),
        "first_doc",
        F.coalesce("classes", F.lit("")).alias("classes"),
        F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("cleaned_sha256"),
    )
