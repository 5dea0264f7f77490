"""Secret scans with DataFrame functions alone.

Three patterns find assigned passwords, access keys and hexadecimal runs. Beyond them a
battery of randomness tests looks at every long run of token characters. Its encoding is
inferred (decimal, hex, base32, base36, base62, base64: the strictest that fits), and each test asks
how likely a random string of that encoding and length is to look so unlike one:

* chi-squared: the counts of the alphabet's symbols against n / |alphabet| of each, with the
  exact mean and variance for n characters and the cube-root form of the tail;
* runs: changes from one class of characters to another (digits, capitals, small letters,
  signs; low and high for decimal) against what the classes' shares give;
* serial correlation of neighbours' places in the alphabet.

Fisher's method joins the three to one chance. Random strings have it spread evenly from 0 to 1,
ordinary words and identifiers have it near 0, so the spread of the upper part tells how many
of the runs of a length class are random, and with them the share of ordinary ones among
those above any threshold. Each length class takes the lowest threshold of a grid that keeps
this share of false findings within ``false_share``, or the highest of the grid. Counts by class
and grid interval are all that is gathered.

Cases: a null text is an empty one; texts without a finding have zero counts, the hash of
the empty string and empty spans; repeated rows each get their row; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import materialize

#: The kinds, in the order in which they are listed, with their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 12
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by falling strictness: name, pattern, symbols, and the symbols of each class.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS, (5, 5)),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6], (10, 6)),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + DIGITS[2:8], (26, 6)),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, (10, 26)),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, (10, 26, 26)),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", DIGITS + UPPER + LOWER + "+/", (10, 26, 26, 2)),
)
#: Encodings whose letters may be of either case, but of one in a run.
ONE_CASE = ("hex", "base36")
#: Lower ends of the length classes, and the thresholds that each may take.
LENGTHS = (0, 24, 32, 48)
GRID = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
#: Matches of a text whose places are summed up together.
TOGETHER = 256


SPAN = "struct<start:int,end:int,kind:int,matched:string>"


def located(kind: str) -> Column:
    """Array of SPAN of all matches of a kind, in code points, end exclusive.

    Reads the columns that ``pieces`` makes: the matches, and what lies between them.
    """
    found, gaps = F.col(f"found_{kind}"), F.col(f"gaps_{kind}")

    size = F.size(found)
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, k: Column) -> Column:
        matched = F.get(found, k)
        start = acc["at"] + F.length(F.get(gaps, k))
        end = start + F.length(matched)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), matched.alias("matched"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def together(first: Column) -> Column:
        places = F.sequence(first, F.least(first + TOGETHER, size) - 1)
        return F.aggregate(places, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def shifted(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), (span["end"] + by).alias("end"), span["kind"].alias("kind"), span["matched"].alias("matched"))

    def onward(acc: Column, chunk: Column) -> Column:
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(chunk["out"], lambda s: shifted(s, acc["at"])))).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), size - 1, F.lit(TOGETHER)), together)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.when(size > 0, F.flatten(F.aggregate(chunks, begin, onward, lambda acc: acc["out"]))).otherwise(empty).alias(kind)


def pieces(text: Column) -> list[Column]:
    out = []
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True):
        out += [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(f"found_{kind}"), F.split(text, pattern, -1).alias(f"gaps_{kind}")]
    return out


def tail(z: Column) -> Column:
    """Chance that a standard normal exceeds ``z`` (logistic form, error below 0.0002)."""
    bound = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return let(bound, lambda x: 1 / (1 + F.exp(1.5976 * x + 0.070566 * x * x * x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inferred(token: Column) -> Column:
    """Place in ENCODINGS of the strictest encoding that fits."""
    out = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(ENCODINGS[k][1]), k).otherwise(out)
    return out


def random_chance(token: Column) -> Column:
    """Chance that a random string of the token's encoding and length looks as little random as this one."""
    one_case = [k for k, (e, *_) in enumerate(ENCODINGS) if e in ONE_CASE]

    def plain(v: Column) -> Column:
        text = F.translate(F.rtrim(F.when(v["e"].isin(one_case), F.lower(v["token"])).otherwise(v["token"]), F.lit("=")), "-_", "+/")
        return F.struct(v["e"].alias("e"), text.alias("text"), F.length(text).cast("double").alias("n"))

    def chance(v: Column) -> Column:
        half = -(F.ln(_uniform(v)) + F.ln(_runs(v)) + F.ln(_serial(v)))
        return let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.struct(inferred(token).alias("e"), token.alias("token")), lambda v: let(plain(v), chance))


def _of(v: Column, values: list) -> Column:
    """The value of the inferred encoding."""
    return F.get(F.array(*map(F.lit, values)), v["e"])


def _uniform(v: Column) -> Column:
    """Chi-squared over the alphabet, from the squares of the counts of the symbols that occur."""
    text, n, m = v["text"], v["n"], _of(v, [float(len(letters)) for _, _, letters, _ in ENCODINGS])

    def add(total: Column, c: Column) -> Column:
        return let(n - F.length(F.replace(text, c, F.lit(""))), lambda k: total + k * k)

    squares = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)
    chi = F.greatest(F.lit(0.0), squares * m / n - n)
    cube = 2 / (9 * ((m - 1) * n / F.greatest(F.lit(1.0), n - 1)))
    return tail((F.pow(chi / (m - 1), F.lit(1 / 3)) - (1 - cube)) / F.sqrt(cube))


def _runs(v: Column) -> Column:
    """Changes of class; their variance has a part from neighbouring places."""
    text, n = v["text"], v["n"]
    classes = F.translate(text, LOWER + UPPER + DIGITS + "/", "a" * 26 + "A" * 26 + "0" * 10 + "+")
    classes = F.when(v["e"] == 0, F.translate(text, DIGITS, "0000011111")).otherwise(classes)
    changes = F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1
    shares = [[k / sum(sizes) for k in sizes] for _, _, _, sizes in ENCODINGS]
    change = [1 - sum(x * x for x in p) for p in shares]
    beside = [sum(x * (1 - x) ** 2 for x in p) - q * q for p, q in zip(shares, change, strict=True)]
    spread = (n - 1) * _of(v, [q * (1 - q) for q in change]) + 2 * (n - 2) * _of(v, beside)
    return tail(((n - 1) * _of(v, change) - changes - 0.5) / F.sqrt(F.greatest(F.lit(1e-9), spread)))


def _serial(v: Column) -> Column:
    """Correlation of each place in the alphabet with the next one, either way."""
    n, alphabet = v["n"], _of(v, [letters for _, _, letters, _ in ENCODINGS])
    begin = F.struct(*(F.lit(0.0).alias(c) for c in ("first", "last", "sum", "squares", "products")))

    def step(a: Column, x: Column) -> Column:
        first = F.when(a["last"] == 0, x).otherwise(a["first"])
        return F.struct(first.alias("first"), x.alias("last"), (a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares"), (a["products"] + a["last"] * x).alias("products"))

    def likely(a: Column) -> Column:
        mean = a["sum"] / n
        total = a["squares"] - a["sum"] * mean
        shared = a["products"] - mean * (2 * a["sum"] - a["first"] - a["last"]) + (n - 1) * mean * mean
        r = F.when(total > 1e-9, shared / total).otherwise(1.0)
        return F.least(F.lit(1.0), 2 * tail(F.abs(r + 1 / n) * F.sqrt(n)))

    places = F.transform(F.split(v["text"], ""), lambda c: F.instr(alphabet, c).cast("double"))
    return let(F.aggregate(places, begin, step), likely)


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(LENGTHS[1:], 1):
        out = F.when(length >= low, k).otherwise(out)
    return out


def thresholds(counts: dict[tuple[int, int], int], false_share: float) -> list[float]:
    """For each length class the lowest threshold that keeps the share of ordinary runs above it within bounds.

    ``counts`` are runs by length class and grid interval (how many of GRID their chance reaches).
    Random runs are spread evenly, so those above the top of the grid tell how many there are in all.
    """
    out = []
    for k in range(len(LENGTHS)):
        above = [sum(counts.get((k, level), 0) for level in range(at + 1, len(GRID) + 1)) for at in range(len(GRID))]
        random = above[-1] / (1 - GRID[-1])
        fit = [t for t, n in zip(GRID, above, strict=True) if n and n - random * (1 - t) <= false_share * n]
        out.append(min(fit, default=GRID[-1]))
    return out


def crossed(spans: Column, s: Column) -> Column:
    """Whether ``s`` has a character in common with one of the spans, which follow each other without overlaps.

    The last of them that starts before the end of ``s`` is found by halving; those before it end earlier.
    """

    def halve(range_: Column, _: Column) -> Column:
        middle = ((range_["low"] + range_["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] < s["end"]
        go = range_["low"] < range_["high"]
        return F.struct(F.when(go & before, middle + 1).otherwise(range_["low"]).alias("low"), F.when(go & ~before, middle).otherwise(range_["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    count = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda r: r["low"])
    return F.coalesce(F.get(spans, count - 1)["end"] > s["start"], F.lit(False))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def bare(s: Column) -> list[Column]:
    return [s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = 0.01) -> DataFrame:
    """Find secrets in every whole text.

    Returns the id, ``base``: an array of (start, end, kind) of what the patterns find, by
    start, then kind as listed in ``KINDS``, and ``found``: the same with the runs that the
    tests declare random and that touch no other finding.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id__"), *pieces(text)).select("id__", *map(located, KINDS))
    assign = F.filter("assign", lambda s: F.length(F.regexp_extract(s["matched"], ASSIGN, 2)) >= LEAST_ASSIGNED)
    base = F.transform(by_start(F.concat("assigned", "access", "hex")), lambda s: F.struct(*bare(s)))
    free = F.filter("random", lambda s: ~(crossed(F.col("assigned"), s) | crossed(F.col("access"), s) | crossed(F.col("hex"), s)))
    judged = F.transform("free", lambda s: F.struct(*bare(s), random_chance(s["matched"]).alias("p"), length_class(F.length(s["matched"])).alias("length")))
    kept = rows.select("id__", assign.alias("assigned"), "access", "hex", "random").select("id__", base.alias("base"), free.alias("free")).select("id__", "base", judged.alias("runs"))
    table = materialize(kept, "secrets")
    level = sum(((F.col("run.p") >= t).cast("int") for t in GRID), F.lit(0))
    seen = table.select(F.explode("runs").alias("run")).groupBy(F.col("run.length").alias("length"), level.alias("level")).count().collect()
    least = F.array(*map(F.lit, thresholds({(r["length"], r["level"]): r["count"] for r in seen}, false_share)))
    chosen = F.transform(F.filter("runs", lambda s: s["p"] >= F.get(least, s["length"])), lambda s: F.struct(*bare(s)))
    return table.select(F.col("id__").alias(id_col), "base", by_start(F.concat("base", chosen)).alias("found"))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
