"""Secret scans: fixed patterns, and Markov models for what no pattern names.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: transitions are counted by
Spark, and their log-likelihood ratios make one table.  Every run of identifier
characters in a text is scored by the sum of that table over its transitions;
a run scored as random, outside what the patterns found, is a span of its own.
In other runs the parts where the sum rises are scored, so that a name or path
joined to a secret doesn't hide it; a part found is a span from separator to
separator.

All of it is Spark expressions: places come from the lengths of matches and of
the pieces between them, in code points.  A row needs only itself, so nothing
is shuffled.  A text is worked on in blocks that end where no match can go on,
so the cost of a long text follows its length; only a text that gives no such
place for long has long blocks.

Defined results: a null text is empty and has no spans; overlapping spans of
different kinds all stay; repeated rows each get their result; an empty table
gives no rows; further columns are ignored by ``scan``, kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import pick

# Fixed values of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

KINDS = ("assign", "access", "hex", "markov")

#: Characters that the models know; every other one shares a place of its own.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Runs of such characters that are scored, and the log-likelihood ratio (in all, and for each transition) from which they are secrets.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
LEAST, LEAST_EACH = 12.0, 0.4
#: Characters of a part that is scored, at least, and how far below its highest sum it goes on.
PART, DROP = 16, 8.0

#: Blocks of some thousand characters, up to one that no match holds: one that is in no pattern, or a space that follows neither the last letter of a name, a quote, a sign nor a space.
BLOCK = r"""(?s).{2048,}?(?:[^A-Za-z0-9+/_.=\-"':\x20]|(?<=[^dDtTnNyY"':=\x20])\x20)|.+"""

#: Share of a uniform distribution in every estimate.
UNIFORM = 0.25

# Words that ordinary identifiers are made of in the labelled samples.
IDENTIFIER_WORDS = (
    "account action active address agent amount answer array author average background balance before between border branch buffer build button cache "
    "callback cancel channel character check child class client close cluster collection column command comment commit common compare complete config "
    "connection constant container content context control convert count create current customer database default delete description destination detail "
    "device direction directory display distance document domain driver duration element enable encoding engine entity error event exception execute "
    "expected export expression factory failure feature field filter format forward function gateway general global group handler header height history "
    "identifier image import index information initial input instance integer interface internal invalid iterator language layout length level library "
    "listener local location logger manager mapping maximum measure member memory message method middle minimum module monitor network notification number "
    "object operation option order output package parameter parent partition password pattern payment performance permission platform pointer position "
    "previous priority process product profile progress project property protocol provider public query queue random range record reference region register"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """token, label: n random strings (label 1) in each of four alphabets, and ordinary identifiers (label 0) in the usual ways of writing them."""
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    i = F.col("id")

    def word(salt: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))

    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    number = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(100000)).cast("string")
    random = [F.substring(digest, 1, 40), F.substring(base64, 1, 40), F.substring(F.translate(base64, "+/=", "xyz"), 1, 32), F.substring(F.translate(F.upper(base64), "+/=", "XYZ"), 1, 24)]
    ordinary = [
        F.concat_ws("_", word(1), word(2), word(3)),
        F.concat_ws("-", word(1), word(2), number),
        F.concat(word(1), F.initcap(word(2)), F.initcap(word(3))),
        F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3))),
        F.upper(F.concat_ws("_", word(1), word(2))),
        F.concat_ws("/", word(1), word(2), word(3)),
        F.concat(word(1), word(2), word(3)),
        F.concat_ws("=", word(1), word(2)),
        F.concat_ws("-", F.lit("2024"), F.lpad(F.pmod(i, F.lit(12)).cast("string"), 2, "0"), F.lpad(F.pmod(i, F.lit(28)).cast("string"), 2, "0"), number),
        F.concat(number, number, number),
        F.repeat(F.substring(F.lit(ALPHABET), (F.pmod(i, F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1)), 24),
        F.concat(word(1), number),
        F.repeat(F.substring(F.lit("=-_"), (F.pmod(i, F.lit(3)) + 1).cast("int"), F.lit(1)), 24),
    ]
    rows = F.array(*[F.struct(x.alias("token"), F.lit(1).alias("label")) for x in random], *[F.struct(x.alias("token"), F.lit(0).alias("label")) for x in ordinary])
    return spark.range(n).select(F.explode(rows).alias("x")).select("x.token", "x.label")


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, random over ordinary, row by row.

    Each estimate is mixed with a uniform share, so that no single odd transition decides.
    """
    size = len(ALPHABET) + 1
    places = samples.select("label", F.split("token", "").alias("c")).where(F.size("c") > 1)
    code = lambda c: F.expr(f"instr('{ALPHABET}', {c})")
    pairs = places.select("label", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1] as a, c[i] as b))")).alias("p")).where("p.b <> ''")
    counts = pairs.groupBy("label", code("p.a").alias("a"), code("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = [[[1e-9] * size for _ in range(size)] for _ in range(2)]
    for r in counts:
        found[r["label"]][r["a"]][r["b"]] += r["n"]
    chance = lambda label, a, b: UNIFORM / size + (1 - UNIFORM) * found[label][a][b] / sum(found[label][a])
    ratio = lambda a, b: math.log(chance(1, a, b) / chance(0, a, b))
    return [round(ratio(a, b), 4) for a in range(size) for b in range(size)]


def log_ratio(token: Column, table: list[float]) -> Column:
    """The sum of the table over a token's transitions."""
    size = len(ALPHABET) + 1
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to one literal
    codes = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(s, c):
        return F.struct(c.cast("int").alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(values, s["last"] * size + c))).alias("sum"))

    return F.aggregate(codes, start, step)["sum"]


def random_parts(said: Column, table: list[float]) -> Column:
    """start and end of the parts of a run that are scored as random: all of it, or what lies between separators around each rise of the running sum."""
    size = len(ALPHABET) + 1
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    codes = F.transform(F.regexp_extract_all(said, F.lit("(?s)."), F.lit(0)), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    equals = ALPHABET.index("=") + 1
    # Of each character but the first: its transition's value, and whether it is the first after signs of equality.
    steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.length(said)), lambda a, b: F.struct(F.get(values, (a * size + b).cast("int")).alias("r"), ((a == equals) & (b != equals)).alias("fresh")))
    part = "struct<start:int,end:int>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("all"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), F.array().cast(f"array<{part}>").alias("out"))

    def with_best(s):
        good = (s["best"] >= LEAST) & (s["best"] >= LEAST_EACH * (s["end"] - s["start"])) & (s["end"] - s["start"] >= PART - 1)
        return F.when(good, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), (s["end"] + 1).alias("end"))))).otherwise(s["out"])

    def step(s, x):
        i, total = s["i"] + 1, s["sum"] + x["r"]
        ends = (total <= 0) | (total < s["best"] - DROP) | x["fresh"]
        more = total > s["best"]
        kept = lambda name, cut, go: F.when(ends, cut).otherwise(go).alias(name)
        return F.when(x["r"].isNull(), s).otherwise(
            F.struct(
                i.alias("i"), (s["all"] + x["r"]).alias("all"), kept("start", i, s["start"]), kept("sum", F.lit(0.0), total),
                kept("best", F.lit(0.0), F.greatest(total, s["best"])), kept("end", i, F.when(more, i).otherwise(s["end"])), kept("out", with_best(s), s["out"]),
            )
        )

    def widened(x):
        own = F.substring(said, x["start"] + 1, F.length(said))
        cut = F.length(F.regexp_extract(own, "^[=/_-]*", 0))
        before = F.when(cut > 0, -cut).otherwise(F.length(F.regexp_extract(F.substring(said, F.lit(1), x["start"]), "[^=/_-]*$", 0)))
        after = F.length(F.regexp_extract(F.substring(said, x["end"] + 1, F.length(said)), "^[^=/_-]*=*", 0))
        return F.struct((x["start"] - before).alias("start"), (x["end"] + after).alias("end"))

    def join(out, x):
        last = F.try_element_at(out, F.lit(-1))
        meet = (F.size(out) > 0) & (x["start"] <= last["end"])
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(meet, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(x)))

    def finish(s):
        whole = (s["all"] >= LEAST) & (s["all"] >= LEAST_EACH * (F.length(said) - 1))
        parts = F.aggregate(F.transform(with_best(s), widened), F.array().cast(f"array<{part}>"), join)
        return F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.length(said).alias("end")))).otherwise(parts)

    return F.aggregate(steps, zero, step, finish)


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """start, place of the kind, end, of each match that ``keep`` accepts; the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,said:string>>").alias("out"))

    def step(s, m):
        start = s["at"] + m["gap"]
        end = start + F.length(m["said"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), m["said"].alias("said"))
        return F.struct(end.alias("at"), F.when(keep(m["said"]), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("said")))
    return F.when(text.rlike(pattern), F.aggregate(both, zero, step)["out"]).otherwise(zero["out"])


def _always(_: Column) -> Column:
    return F.lit(True)


def _value_is_long(said: Column) -> Column:
    return F.length(F.regexp_extract(said, ASSIGN, 2)) >= 6


def _without(text: Column, spans: Column) -> Column:
    """The text with a blank for each character of ordered spans, so that runs end there and places stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        start = F.greatest(s["at"], x["start"])
        end = F.greatest(s["at"], x["end"])
        said = F.concat(s["out"], text.substr(s["at"] + 1, start - s["at"]), F.repeat(F.lit(" "), end - start))
        return F.struct(end.alias("at"), said.alias("out"))

    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def _found(text: Column, table: list[float]) -> Column:
    """base and all: the spans of one block of text, ordered by start and kind."""
    parts = F.concat(_spans(text, ASSIGN, "assign", _value_is_long), _spans(text, ACCESS, "access", _always), _spans(text, HEX, "hex", _always))
    parts_of = lambda m: F.transform(random_parts(m["said"], table), lambda x: F.struct((m["start"] + x["start"]).alias("start"), m["kind"].alias("kind"), (m["start"] + x["end"]).alias("end")))

    def with_more(base):
        rest = F.when(F.size(base) > 0, _without(text, base)).otherwise(text)
        more = F.flatten(F.transform(_let(rest, lambda t: _spans(t, RUN, "markov", _always)), parts_of))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, _plain(more))).alias("all"))

    return _let(_plain(parts), with_more)


def with_spans(documents: DataFrame, table: list[float]) -> DataFrame:
    """Adds blocks_: for each block of the text what it says, its number of characters, and its spans base and all."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = lambda said: _let(_found(said, table), lambda x: F.struct(said.alias("said"), F.length(said).alias("n"), x["base"].alias("base"), x["all"].alias("all")))
    return documents.withColumn("blocks_", F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), one))


def _placed(which: str) -> Column:
    """The spans of all blocks, with places in the whole text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    starts = F.aggregate("blocks_", zero, add)["out"]
    shift = lambda b, at: F.transform(b[which], lambda x: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end")))
    return F.flatten(F.zip_with("blocks_", starts, shift))


def _said(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(documents: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document."""
    table = table or train(labelled_samples(documents.sparkSession))
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    rows = with_spans(docs, table).select("doc_id", _placed("base").alias("base_spans_"), _placed("all").alias("spans_"))
    return rows.select("doc_id", *[count("base_spans_", k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_said("base_spans_"), 256).alias("base_sha256"), _said("spans_").alias("spans"), count("spans_", "markov").alias("n_markov"))


def redact(documents: DataFrame, mark: str = "[SECRET]", table: list[float] | None = None) -> DataFrame:
    """The documents, with all their columns, where each run of overlapping spans is replaced by the mark; n_chars, if there, follows the text."""
    table = table or train(labelled_samples(documents.sparkSession))
    # The columns travel as one, whatever they are called.
    rows = with_spans(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("text").cast("string").alias("text")), table)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def clean(block):
        text = block["said"]

        def step(s, x):
            fresh = (x["start"] >= s["at"]) & ((x["start"] > 0) | (s["at"] == 0))
            said = F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, said).otherwise(s["out"]).alias("out"))

        return F.when(F.size(block["all"]) > 0, F.aggregate(block["all"], zero, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))).otherwise(text)

    found = F.exists("blocks_", lambda b: F.size(b["all"]) > 0)
    rows = rows.select("row", found.alias("found"), F.when(found, F.array_join(F.transform("blocks_", clean), "")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    fields = []
    for f in documents.schema:
        old = F.col(f"row.`{f.name}`")
        fields.append((F.when(F.col("found"), new[f.name].cast(f.dataType)).otherwise(old) if f.name in new else old).alias(f.name))
    return rows.select(*fields)
