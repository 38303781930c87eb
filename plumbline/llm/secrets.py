"""Secret spans in texts, by DataFrame functions alone.

Three patterns find base spans; character Markov models add stretches that look drawn
at random. The models are first-order transition tables over one alphabet: one for
ordinary identifiers and words, and one for each kind of random strings, counted by a
query over labelled samples. A run of at least 12 characters is cut at its separators
into parts, each with the summed log-likelihood ratio of the kind that suits it best.
All stretches of parts whose sum exceeds a threshold are secrets. So each key in a
path is found, the words between keys stay, and a long word adds up to nothing.

Spark has no function for the places of matches. Splitting a text by the pattern
gives the gaps between matches, and running sums of gap and match lengths give
the places, in code points. All work is linear in a text's length and its spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, with the least length of what group `group` holds.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
RUN = r"[A-Za-z0-9+/_.-]{12,}={0,2}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
# Words of ordinary identifiers.
WORDS = (
    "account active agent allow answer attribute author balance batch begin body branch button call category channel child client clone close code column "
    "common config constant context convert count current customer data database debug delete description detail different display domain duration element "
    "empty enable end entity error example execute expand expression external feature file find first flag format frame function generate graph handle "
    "header hidden host image import index initial insert integer internal item label last layout level limit line link listen local lock mapping master "
    "maximum memory message middle mode model module mother navigation next normal number observer operation order output page panel parameter parser path "
    "payment percent person place plugin policy power previous price primary process profile project protocol public queue range reader reference register "
    "relation release remove replace request reset response return role route scale schema scope score script section select sequence server session shape "
    "should simple size source space stack start station storage string style subject support symbol table target task template test thread title token "
    "trace transaction transform tree type union unique update user value vector version view volume weight width with without word world writer"
).split()
# Common words of other languages that texts are written in.
OTHER_WORDS = (
    "aber alle andere arbeit auch ausschuss bedeutung beziehung deutsch durch einheit entscheidung entwicklung erfahrung freiheit gegen gesellschaft "
    "geschwindigkeit gleich heute keine leben menschlich nicht schule sein sprache staat unter verbindung verschieden wirtschaft wissenschaft zwischen "
    "dampf kampf kopf pferd pflanze pflegen pflicht pfund zuerst zugang zukunft zusammen platz schutz gesetz netz aufbau bezug "
    "ainsi alors autre avant avec beaucoup bureau chercher comme connaissance dans depuis encore faire gouvernement heureux jour lettre maintenant monde "
    "notre nouveau parce peut pour quelque question raison rien seulement tableau temps toujours travail vieux voiture "
    "adem algo antes aunque ciudad como conocimiento cuando desarrollo desde donde ejemplo entre espacio estado forma general gobierno hacer hasta lugar "
    "manera mientras mundo mucho nosotros para porque problema pueblo siempre sobre tiempo trabajo universidad vida ejemplar jamas lejos pareja"
).split()
#: Labelled samples of each kind that the models are trained on.
SAMPLES = 4000
#: Characters of the shortest stretch, separators at its ends aside.
LEAST = 10
#: Nats by which a stretch must look more random than ordinary: one with a digit, a capital behind a small letter or a part of capitals, and any other, as ordinary words are written.
THRESHOLD, LETTERS = 9.0, 16.0
#: Nats that a stretch's sum may fall below its best before it is closed; less than either threshold.
CLOSING = 8.0
ORDINARY = "ordinary"


# ---------------------------------------------------------------- models
def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, kind): n random strings of kind "mixed", n of kind "upper" and 3 n ordinary strings, from a rule without chance.

    Mixed ones are Base64, URL-safe Base64, Base62, lower-case hexadecimal, and
    lower-case letters with digits; upper ones are Base32, upper-case hexadecimal, and
    upper-case letters with digits. Ordinary ones join one to four words of several
    languages by case, underscores, hyphens, points, slashes or nothing, some with a
    number, and some are numbers or dates.
    """
    pool = [*WORDS, *WORDS, *OTHER_WORDS]
    words = F.split(F.lit(" ".join(pool)), " ")
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    pick = lambda k: F.element_at(words, (draw(k, len(pool)) + 1).cast("int"))
    some, more = spark.range(n), spark.range(3 * n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(F.substring(digest, 1, 60)))
    base62 = F.regexp_replace(base64, "[+/=]", "")
    kind = F.pmod(F.col("id"), F.lit(5))
    mixed = F.when(kind == 0, base64).when(kind == 1, F.translate(base64, "+/", "-_")).when(kind == 2, base62).when(kind == 3, F.substring(digest, 1, 40)).otherwise(F.lower(base62))
    kind = F.pmod(F.col("id"), F.lit(3))
    upper = F.when(kind == 0, F.translate(F.upper(base62), "0189", "")).when(kind == 1, F.upper(F.substring(digest, 1, 40))).otherwise(F.upper(base62))
    parts = F.slice(F.array(*(pick(k) for k in range(4))), 1, (draw("parts", 4) + 1).cast("int"))
    style = draw("style", 12)
    number = draw("number", 100_000).cast("string")
    joined = (
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, F.array_join(parts, "-"))
        .when(style == 2, F.upper(F.array_join(parts, "_")))
        .when(style == 3, F.array_join(F.transform(parts, F.initcap), ""))
        .when(style == 4, F.concat(F.array_join(parts, "_"), number))
        .when(style == 5, F.upper(F.array_join(parts, "")))
        .when(style == 6, F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit(".html")))
        .when(style == 7, F.concat(F.lit("www."), F.array_join(parts, "."), F.lit(".com")))
        .when(style == 8, F.concat_ws("-", F.lit(2000) + draw("y", 30), F.lpad((draw("m", 12) + 1).cast("string"), 2, "0"), F.lpad((draw("d", 28) + 1).cast("string"), 2, "0"), pick(9)))
        .when(style == 9, F.concat(number, number))
        .otherwise(F.array_join(parts, ""))
    )
    return some.select(mixed.alias("text"), F.lit("mixed").alias("kind")).unionByName(some.select(upper.alias("text"), F.lit("upper").alias("kind"))).unionByName(more.select(joined.alias("text"), F.lit(ORDINARY).alias("kind")))


def train(samples: DataFrame) -> list[list[float]]:
    """A table of log-ratios for each kind but ORDINARY, in the kinds' order: entry a * (K + 1) + b for the places a, b (from 1) of two characters in the alphabet, 0 for any other.

    samples has (text, kind); null texts and characters outside the alphabet are
    passed over. What is gathered has a row for each kind and pair of characters at most.
    """
    size = len(ALPHABET)
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.split("text", "")
    pairs = samples.where(F.length("text") > 1).select("kind", F.explode(F.zip_with(F.slice(chars, 1, F.length("text") - 1), F.slice(chars, 2, F.length("text")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    counts = pairs.select("kind", at(F.col("p.a")).alias("a"), at(F.col("p.b")).alias("b")).where("a > 0 and b > 0").groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    grids: dict[str, list[list[float]]] = {}
    for row in counts.collect():  # at most kinds * len(ALPHABET) ** 2
        grids.setdefault(row["kind"], [[0.5] * (size + 1) for _ in range(size + 1)])[row["a"]][row["b"]] += row["n"]
    plain = grids.pop(ORDINARY, [[0.5] * (size + 1) for _ in range(size + 1)])
    out = []
    for kind in sorted(grids):
        table = [0.0] * (size + 1) ** 2
        for a in range(1, size + 1):
            r, o = grids[kind][a], plain[a]
            both = sum(r[1:]), sum(o[1:])
            for b in range(1, size + 1):
                table[a * (size + 1) + b] = math.log(r[b] / both[0]) - math.log(o[b] / both[1])
        out.append(table)
    return out


def part_value(part: Column, model: list[Column], threshold: Column) -> Column:
    """How much more random than ordinary letters and digits look: the sum of their transitions' log-ratios, for the kind that suits best; where a stretch inside exceeds the threshold, that stretch's sum if it is more."""
    size = len(ALPHABET) + 1
    start = F.struct(*(F.lit(0.0).alias(k) for k in ("all", "cur", "best")))

    def step(t: Column, x: Column) -> Column:
        cur = F.greatest(t["cur"], F.lit(0.0)) + x
        return F.struct((t["all"] + x).alias("all"), cur.alias("cur"), F.greatest(t["best"], cur).alias("best"))

    def one(places: Column, table: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p: F.element_at(table, p)), start, step, lambda t: F.when(t["best"] > threshold, F.greatest(t["all"], t["best"])).otherwise(t["all"]))

    def best(codes: Column) -> Column:
        places = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * size + b + 1)
        return _let(places, lambda p: F.array_max(F.array(*(one(p, t) for t in model))))

    return F.when(F.length(part) < 2, F.lit(0.0)).otherwise(_let(F.transform(F.split(part, ""), lambda c: F.instr(F.lit(ALPHABET), c)), best))


_PLACES = "array<struct<s:int,e:int>>"


def stretches(run: Column, model: list[Column], threshold: float = THRESHOLD, letters: float = LETTERS) -> Column:
    """All stretches (s, e) of a run's characters that look random, in order.

    A run is letters and digits with separators between. A stretch begins and ends
    with parts that add to its sum, so ordinary words at its ends stay outside. It is
    closed where its sum has fallen by CLOSING below its best, as that is less than
    the threshold, nothing that exceeds it is passed over. A part of hexadecimal
    digits beside a hyphen adds nothing but isn't ordinary: identifiers in groups stay
    whole. Equals signs behind a stretch belong to it.
    """
    limit = lambda mix: F.when(mix, F.lit(float(threshold))).otherwise(F.lit(float(letters)))
    mixed = "[0-9]|[a-z][A-Z]|^[A-Z]+$"
    digits = "^[0-9a-f]*[0-9][0-9a-f]*$|^[0-9A-F]*[0-9][0-9A-F]*$"

    def valued(items: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(items, i - 1) == "-", F.lit(False)) | F.coalesce(F.get(items, i + 1) == "-", F.lit(False))
        value = lambda x, i: _let(part_value(x, model, limit(x.rlike(mixed))), lambda v: F.when(x.rlike(digits) & beside(i), F.greatest(v, F.lit(0.01))).otherwise(v))
        return F.transform(items, lambda x, i: F.struct(F.length(x).alias("n"), F.when(x.rlike("^[A-Za-z0-9]"), value(x, i)).alias("v"), x.rlike(mixed).alias("mix")))

    none, nothing = F.array().cast(_PLACES), F.array().cast(f"array<{_PLACES}>")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0.0).alias("cur"), F.lit(0).alias("at"), F.lit(0.0).alias("best"), F.lit(0).alias("e"), F.lit(False).alias("mix"), F.lit(False).alias("held"), none.alias("out"), nothing.alias("full"))

    def added(t: Column) -> Column:
        good = (t["best"] > limit(t["held"])) & (t["e"] - t["at"] >= LEAST)
        return F.when(good, F.concat(t["out"], F.array(F.struct(t["at"].alias("s"), t["e"].alias("e"))))).otherwise(t["out"])

    def step(t: Column, x: Column) -> Column:
        sum_, pos = t["cur"] + x["v"], t["pos"] + x["n"]
        on = t["cur"] > 0
        close = on & ((sum_ <= 0) | (sum_ < t["best"] - CLOSING))
        idle = F.struct(pos.alias("pos"), *(t[k].alias(k) for k in ("cur", "at", "best", "e", "mix", "held", "out", "full")))
        many = F.size(t["out"]) >= 256  # full lists are set aside, so that they aren't copied for each new entry
        shut = F.struct(pos.alias("pos"), F.lit(0.0).alias("cur"), pos.alias("at"), F.lit(0.0).alias("best"), pos.alias("e"), F.lit(False).alias("mix"), F.lit(False).alias("held"), F.when(many, none).otherwise(added(t)).alias("out"), F.when(many, F.concat(t["full"], F.array(added(t)))).otherwise(t["full"]).alias("full"))
        fresh = F.struct(pos.alias("pos"), x["v"].alias("cur"), t["pos"].alias("at"), F.greatest(x["v"], F.lit(0.0)).alias("best"), pos.alias("e"), x["mix"].alias("mix"), x["mix"].alias("held"), t["out"].alias("out"), t["full"].alias("full"))
        more = F.struct(pos.alias("pos"), sum_.alias("cur"), t["at"].alias("at"), F.greatest(sum_, t["best"]).alias("best"), F.when(sum_ > t["best"], pos).otherwise(t["e"]).alias("e"), (t["mix"] | x["mix"]).alias("mix"), F.when(sum_ > t["best"], t["mix"] | x["mix"]).otherwise(t["held"]).alias("held"), t["out"].alias("out"), t["full"].alias("full"))
        return F.when(x["v"].isNull(), idle).when(close, shut).when(on, more).otherwise(fresh)

    found = F.aggregate(_let(F.regexp_extract_all(run, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0)), valued), start, step, lambda t: F.concat(F.flatten(t["full"]), added(t)))
    tail = lambda f: F.length(F.regexp_extract(F.substring(run, f["e"] + 1, F.length(run)), "^=*", 0))
    return F.transform(found, lambda f: F.struct(f["s"].alias("s"), (f["e"] + tail(f)).alias("e")))


def model_column(table: list[float]) -> Column:
    """The table as a constant array, folded once when the plan is made."""
    return F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")


# ---------------------------------------------------------------- places
def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _scan(steps: Column, op) -> Column:
    """Inclusive running results of op over non-negative numbers, block by block so that long arrays aren't copied once for each entry."""
    block, none = 256, F.array().cast("array<long>")

    def small(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), none.alias("o"))
        return F.aggregate(a, start, lambda t, x: F.struct(op(t["s"], x).alias("s"), F.concat(t["o"], F.array(op(t["s"], x))).alias("o")), lambda t: t["o"])

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), op))
        return F.flatten(F.zip_with(F.transform(blocks, small), F.concat(F.array(F.lit(0).cast("long")), small(totals)), lambda b, base: F.transform(F.coalesce(b, none), lambda x: op(base, x))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))
    return F.when(F.size(steps) > 0, _let(steps, lambda v: _let(cut(v), whole))).otherwise(none)


def _sums(steps: Column) -> Column:
    return _scan(steps, lambda a, b: a + b)


def _peaks(values: Column) -> Column:
    return _scan(values, lambda a, b: F.greatest(a, b))


_SPAN = "array<struct<start:long,ord:int,end:long,kind:string>>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(s, m, h) of each match: where it ends, the match, and what the group holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = matches if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.split(text, pattern, -1), F.concat(F.array(F.lit("")), matches), lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
    return F.zip_with(_sums(steps), F.zip_with(matches, held, lambda m, h: F.struct(m.alias("m"), h.alias("h"))), lambda s, x: F.struct(s.alias("s"), x["m"].alias("m"), x["h"].alias("h")))


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """The kind's base spans in a text, in order."""
    good = F.filter(_matches(text, pattern, group), lambda x: F.length(x["h"]) >= least)
    spans = F.transform(good, lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("ord"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(pattern), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _random_spans(text: Column, model: list[Column], threshold: float, letters: float) -> Column:
    """Spans of all stretches that look random, in order."""

    def judged(x: Column) -> Column:
        span = lambda f: F.struct((x["s"] + f["s"]).alias("start"), F.lit(len(BASE)).alias("ord"), (x["s"] + f["e"]).alias("end"), F.lit("random").alias("kind"))
        return F.transform(stretches(x["m"], model, threshold, letters), span)

    found = F.flatten(F.transform(F.filter(_matches(text, RUN, 0), lambda x: x["m"].isNotNull()), judged))
    return F.when(text.rlike(RUN), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def with_spans(docs: DataFrame, model: list[list[float]], threshold: float = THRESHOLD, letters: float = LETTERS, text_col: str = "text", base_col: str = "base_spans", all_col: str = "spans") -> DataFrame:
    """docs with two arrays of (start, ord, end, kind): base spans, and those with the models' spans, each in order.

    A null or empty text has none. Other columns stay as they are; base_col and
    all_col must be new names. A stretch that lies in a base span adds nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if {base_col, all_col} & set(docs.columns):
        raise ValueError(f"{base_col} and {all_col} must be new names")
    one = docs.withColumn(base_col, F.array_sort(F.concat(*(_spans(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE)))))
    found = _random_spans(text, [model_column(t) for t in model], threshold, letters) if model else F.array().cast(_SPAN)

    def fresh(every: Column) -> Column:  # a base span that begins no later stands before a stretch
        reach = _peaks(F.transform(every, lambda s: F.when(s["ord"] < len(BASE), s["end"]).otherwise(F.lit(0).cast("long"))))
        both = F.zip_with(every, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r")))
        return F.transform(F.filter(both, lambda x: (x["s"]["ord"] < len(BASE)) | (x["r"] < x["s"]["end"])), lambda x: x["s"])

    return one.withColumn(all_col, _let(found, lambda f: F.when(F.size(f) > 0, _let(F.array_sort(F.concat(F.col(base_col), f)), fresh)).otherwise(F.col(base_col))))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pieces(text: Column, spans: Column) -> Column:
    """What a text holds between its spans, which are in order; those that touch or overlap count as one."""
    block = 4096

    def between(blocks: Column, a: Column, b: Column) -> Column:  # a text is cut into blocks once, as each substring reads from the start
        own = lambda k: F.substring(F.element_at(blocks, (k + 1).cast("int")), (F.greatest(a - k * block, F.lit(0)) + 1).cast("int"), (F.least(b - k * block, F.lit(block)) - F.greatest(a - k * block, F.lit(0))).cast("int"))
        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / block).cast("int"), F.floor((b - 1) / block).cast("int")), own), "")).otherwise("")

    def cut(x: Column) -> Column:
        reach = F.concat(F.array(F.lit(-1).cast("long")), _peaks(F.transform(spans, lambda s: s["end"])))
        starts = F.filter(F.zip_with(F.transform(spans, lambda s: s["start"]), reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda g: g["s"] > g["r"])
        gaps = F.concat(starts, F.array(F.struct(F.length(text).cast("long").alias("s"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("r"))))
        return F.transform(gaps, lambda g: between(x, F.greatest(g["r"], F.lit(0)), g["s"]))

    return _let(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int")), lambda b: F.substring(text, b * block + 1, F.lit(block))), cut)


def redact(docs: DataFrame, model: list[list[float]], mark: str = "[SECRET]", threshold: float = THRESHOLD, letters: float = LETTERS, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each stretch of spans replaced by a mark; all other columns stay, but for a text's new length in chars_col.

    Null and empty texts stay as they are; repeated rows are kept.
    """
    columns = docs.columns
    base, every = "_base_spans", "_every_span"
    while base in columns or every in columns:
        base, every = base + "_", every + "_"
    out = with_spans(docs, model, threshold, letters, text_col, base, every).withColumn(text_col, F.when(F.size(every) > 0, F.array_join(_pieces(F.col(text_col), F.col(every)), mark)).otherwise(F.col(text_col)))
    if chars_col in columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.size(every) > 0, F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.select(*columns)
