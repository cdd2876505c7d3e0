"""Personal data: base patterns, and identifiers found by bootstrapped contexts. DataFrame operations only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. They and keys (long runs of hexadecimal
digits, which are no spans of their own) seed lexical patterns: the word and the signs before a mention, and those after
it. Patterns and the instances that they extract (identifier-like tokens in context) form a graph; scores go back and
forth over it for some rounds, so that an instance trusted in one round makes patterns of the next. Instances in
patterns that end with high confidence are further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, cut, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive where nothing is given back, so no text makes them slow or deep; an
#: e-mail's local part and a number start where a run does, or right after the last match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
BLOCK = 256
#: Characters on each side of a mention that patterns come from; of a longer word the part nearest to the mention counts.
NEAR = 80
#: What stands between words in a pattern: blanks, quotes, brackets and the signs after labels.
JOINT = r"\x20\x09-\x0D\"'()<>\[\]{}=:,;"
BLANKS = r"[\x20\x09-\x0D]+"
#: A token that may be an identifier: six characters or more that ids are written in, a digit among them.
TOKEN = r"(?<![A-Za-z0-9@._+/-])(?=[A-Za-z@._+/-]*+[0-9])[A-Za-z0-9@._+/-]{6,}+"
#: Tokens that are seeds by their shape: keys and digests of 128, 160 or 256 bits.
KEY = r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"
ROUNDS = 4
#: A pattern is trusted if this share of what stands in its place anywhere are identifiers, this many different ones; an
#: instance is if its patterns say so with this probability.
SURE, LEAST = 0.6, 3


def found(text: Column, pattern: str, needs: str) -> Column:
    """Start, end (code points, exclusive), value and surroundings of each match, leftmost and without overlap.

    Places are sums of the lengths of the gaps and matches before. They are taken by blocks, so a text with very many
    matches costs little more for each.
    """
    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")))

    def steps(x: Column) -> Column:
        n = F.size(x["hits"])
        near = F.zip_with(F.slice(x["gaps"], F.lit(1), n), F.slice(x["gaps"], F.lit(2), n), lambda a, b: F.struct(F.length(a).alias("skip"), F.right(a, F.lit(NEAR)).alias("left"), F.left(b, F.lit(NEAR)).alias("right")))
        return F.zip_with(near, x["hits"], lambda g, h: F.struct(g["skip"].alias("skip"), F.length(h).alias("size"), h.alias("value"), g["left"].alias("left"), g["right"].alias("right")))

    none = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct((start + x["size"]).alias("at"), F.concat(state["all"], F.array(span)).alias("all"))

    def block(steps: Column, b: Column) -> Column:
        base = F.aggregate(F.slice(steps, F.lit(1), b * BLOCK), F.lit(0), lambda s, x: s + x["skip"] + x["size"])
        return F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.struct(base.alias("at"), none.alias("all")), step, lambda s: s["all"])

    # one-element arrays bind what is used again, so that it is made once
    numbers = lambda x: F.sequence(F.lit(0), ((F.greatest(F.size(x), F.lit(1)) - 1) / BLOCK).cast("int"))
    blocks = lambda x: F.flatten(F.transform(numbers(x), lambda b: block(x, b)))
    placed = F.flatten(F.transform(F.transform(once, steps), blocks))
    return F.when(text.rlike(needs), placed).otherwise(none)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        turned = F.reverse(digits)
        total = F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda s, i: s + F.when(i > F.length(digits), 0).otherwise(F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(doubled(F.substring(turned, i, F.lit(1)).cast("int")))))
        return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def pattern_at(side: str, context: Column) -> Column:
    """The word beside a mention and the blanks and signs between, in lower case, runs of blanks as one; empty if nothing is between."""
    unit = f"([^{JOINT}]+[{JOINT}]+)$" if side == "L" else f"^([{JOINT}]+[^{JOINT}]+)"
    return F.regexp_replace(ascii_lower(F.regexp_extract(context, unit, 1)), BLANKS, " ")


def units(text: Column) -> Column:
    """All patterns that could stand before or after something in a text."""
    flat = F.regexp_replace(ascii_lower(text), BLANKS, " ")
    before = F.transform(F.regexp_extract_all(flat, F.lit(f"[^{JOINT}]+[{JOINT}]+"), F.lit(0)), lambda u: F.concat(F.lit("L:"), F.right(u, F.lit(NEAR))))
    after = F.transform(F.regexp_extract_all(flat, F.lit(f"[{JOINT}]+[^{JOINT}]+"), F.lit(0)), lambda u: F.concat(F.lit("R:"), F.left(u, F.lit(NEAR))))
    return F.concat(before, after)


def mentions(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_doc (the columns keep of docs) with _row, an array of valid spans for each base kind, and other (identifier-like tokens apart from those)."""
    text = F.col("_text")
    df = docs.select(F.struct(*keep).alias("_doc"), text_of().alias("_text"))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", F.filter(found(text, PATTERNS[kind], NEEDS[kind]), lambda s: valid(kind, s["value"])))
    clear = lambda s: ~F.exists(F.concat(*[F.col(f"_{k}") for k in KINDS]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("_other", F.filter(found(text, TOKEN, "[0-9]"), clear))
    return df.withColumn("_row", F.monotonically_increasing_id())


def edges_of(table: DataFrame) -> DataFrame:
    """pattern (L: or R: and what stands there), value, seed, base and _row, start, end for each side of each mention."""
    seed = lambda k, s: F.lit(True) if k != "other" else s["value"].rlike(KEY)
    parts = [F.transform(f"_{k}", lambda s: F.struct(s.alias("s"), seed(k, s).alias("seed"), F.lit(k != "other").alias("base"))) for k in (*KINDS, "other")]
    each = table.select("_row", F.explode(F.concat(*parts)).alias("m"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), pattern_at(side, F.col(f"m.s.{name}")).alias("unit")) for side, name in (("L", "left"), ("R", "right"))])
    each = each.select("_row", "m.seed", "m.base", "m.s.start", "m.s.end", "m.s.value", F.explode(sides).alias("p")).where("p.unit <> ''")
    return each.select("_row", "seed", "base", "start", "end", "value", F.concat_ws(":", "p.side", "p.unit").alias("pattern"))


def trusted_patterns(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern and confidence of those that end with SURE or more.

    A pattern's confidence is the sum of its instances' scores over all occurrences of the pattern in docs, whatever
    stands in the instance's place; it is 0 until LEAST different instances score SURE. An instance's score is 1 for a
    seed, else noisy-or over its patterns. Scores go round until no confidence moves, ROUNDS times at most. Patterns with
    fewer than LEAST instances, or of whose occurrences fewer than SURE have one, can't be trusted in any round: they
    are left out first.
    """
    graph = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    sizes = graph.groupBy("pattern").agg(F.sum("n").alias("most"), F.count("*").alias("values"))
    hopeful = cut(sizes.where(F.col("values") >= LEAST).select("pattern", "most"), "pii-patterns")
    occurs = docs.select(F.explode(units(text_of())).alias("unit")).join(hopeful.select(F.col("pattern").alias("unit")), "unit").groupBy("unit").agg(F.count("*").alias("all"))
    all_ = F.greatest("most", F.coalesce("all", F.lit(0)))
    fit = hopeful.join(occurs, hopeful["pattern"] == occurs["unit"], "left").select("pattern", "most", all_.alias("all")).where(F.col("most") >= SURE * F.col("all"))
    graph = cut(graph.join(fit.select("pattern", "all"), "pattern"), "pii-graph")
    scored = graph.withColumn("score", F.col("seed").cast("double"))
    for turn in range(ROUNDS):
        sure = F.count(F.when(F.col("score") >= SURE, 1)) >= LEAST
        pattern = cut(scored.groupBy("pattern").agg(F.when(sure, F.sum(F.col("n") * F.col("score")) / F.first("all")).otherwise(0.0).alias("confidence")), "pii-scores")
        found = tuple(pattern.agg(F.count(F.when(F.col("confidence") >= SURE, 1)), F.round(F.sum("confidence"), 9)).first())
        if not found[0] or (turn and found == last):
            break
        last = found
        miss = F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9))))
        instance = graph.join(pattern, "pattern").groupBy("value").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(miss)).alias("score"))
        scored = graph.join(instance, "value")
    return pattern.where(F.col("confidence") >= SURE)


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_doc (the columns keep of docs), _text, and _spans: structs kind, start, end in the order of kinds, then start.

    Every row gives a row; a null text is empty. Kinds are those of KINDS, then context for what trusted patterns found.
    """
    table = cut(mentions(docs, keep), "pii-mentions")
    edges = edges_of(table)
    trusted = trusted_patterns(edges, docs).select("pattern")
    new = edges.where(~F.col("base")).join(trusted, "pattern").select("_row", F.struct("start", "end").alias("s"))
    new = new.groupBy("_row").agg(F.array_sort(F.collect_set("s")).alias("_context")).withColumnRenamed("_row", "_of")
    table = table.join(new, F.col("_row") == F.col("_of"), "left")
    parts = [F.transform(f"_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]
    extra = F.transform(F.coalesce("_context", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(F.lit("context").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return table.select("_doc", "_text", F.concat(*parts, extra).alias("_spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    df = find(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["kind"] != "context")
    return df.select("_doc.doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; spans that overlap become one, of the first kind."""
    df = find(docs, docs.columns)
    ordered = F.array_sort("_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring("_text", state["at"] + 1, s["start"] - state["at"])
        put = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), put.alias("out"))

    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring("_text", s["at"] + 1, F.length("_text"))))
    text = F.when(F.size("_spans") == 0, F.col("_doc.text")).otherwise(clean)
    return df.select(*[text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
