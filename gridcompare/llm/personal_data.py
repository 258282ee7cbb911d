"""Personal data in text: fixed patterns, and identifiers found from the words before them.

Emails, IP addresses, card and phone numbers found by fixed patterns are the seeds. Their left contexts (the two
words before, white space of any kind between them) become lexical patterns. Patterns and the identifier-like tokens
that follow them form a graph, which is scored in rounds: a pattern is as trustworthy as the share of known identifiers
among the different instances that follow it in the corpus. An instance is a whole match, blanks included, or else a
word without the punctuation around it; plain words are instances too. A token is as trustworthy as its patterns. Tokens above a threshold are new
identifiers, and count as known in the next round. DataFrame expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcompare.llm.storage import is_small, stored, unused

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds. Repetitions are possessive where giving back cannot help, so
# that long runs need neither time nor stack.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a token must look like to be taken for a kind by its context.
SHAPES = {
    "email": r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^(?:[0-9][.\x20_-]?){12,19}$",
    "phone": r"^\(?(?:[0-9][().\x20/_-]{0,2}){7,15}$",
}
# What context may find: a word with a digit or an at sign, or digit groups with blanks between them.
TOKEN = r"\S*[0-9@]\S*"
RUN = r"(?<![^\s\"'(\[{<,;:])\(?[0-9](?:[().\x20/_-]{0,2}+[0-9])++(?![A-Za-z@])"
LEAD = r"[\"'(\[{<,;:]"
TRAIL = r"[\"')\]}>.,;:!?]"
ROUNDS = 3
LEAST_SUPPORT = 3  # distinct identifiers a pattern must be seen with
LEAST_CONFIDENCE = 0.8
BROADCAST_PATTERNS = 500_000


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")  # noqa: E731  counted from the right
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    small_parts = F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    card = F.length(digits).between(14, 19)
    return (
        F.when(kind == "ip", small_parts)
        .when(kind == "card", card & F.when(card, _luhn(digits)))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("text_key"), F.char_length(text).alias("size")


def _may_hold(text: Column) -> Column:
    return text.rlike("[0-9@]")


def _opened(text: Column) -> Column:
    """Lower case, and words without the punctuation before them; a word of nothing else stays."""
    return F.regexp_replace(F.lower(text), rf"(?<!\S){LEAD}+(?=\S)", "")


def _matches(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(text_key, size, kind, word, start, end, value, context): leftmost matches of each pattern that do not overlap.
    ``word`` numbers the words between white space, and is that of the word in which a match starts. Tokens have the
    two words before them as ``context``, null where there are not two. Positions are code points, end exclusive."""
    parts = []
    for kind, pattern in patterns.items():
        parts.append(
            F.struct(
                F.lit(kind).alias("kind"),
                F.arrays_zip(
                    F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("value"),
                    F.split("text", pattern, -1).alias("gap"),
                ).alias("found"),
            )
        )
    rows = texts.select("text_key", "size", F.inline(F.array(*parts))).where("size(found) > 1")
    rows = rows.select("text_key", "size", "kind", F.posexplode("found").alias("i", "m"))
    breaks = lambda c: F.size(F.split(c, r"\s+", -1)) - 1  # noqa: E731  no match begins or ends with white space
    rows = rows.select(
        "text_key", "size", "kind", "i", F.col("m.value").alias("value"), F.char_length("m.gap").alias("between"),
        breaks(F.col("m.gap")).alias("breaks"), F.when(F.col("m.value").isNotNull(), breaks(F.col("m.value"))).alias("inside"),
        # Between tokens there are whole words only.
        F.when(F.col("kind") == "token", F.expr("slice(reverse(filter(split(m.gap, '\\\\s+'), w -> w <> '')), 1, 2)")).alias("tail"),
    )
    one = Window.partitionBy("text_key", "size", "kind").orderBy("i")
    none = F.array().cast("array<string>")
    back = lambda c, n: F.lag(c, n).over(one)
    nearest = F.concat(
        F.coalesce("tail", none), F.array(back("value", 1)), F.coalesce(back("tail", 1), none), F.array(back("value", 2))
    )
    nearest = F.array_compact(nearest)
    length, inside = F.coalesce(F.char_length("value"), F.lit(0)), F.coalesce("inside", F.lit(0))
    rows = rows.withColumns({
        "end": F.sum(F.col("between") + length).over(one),
        "word": (F.sum(F.col("breaks") + inside).over(one) - inside).cast("int"),
        "nearest": F.when(F.col("kind") == "token", nearest),
    }).where("value IS NOT NULL")
    context = F.concat_ws(" ", _opened(F.get("nearest", F.lit(1))), _opened(F.get("nearest", F.lit(0))))
    return rows.select(
        "text_key", "size", "kind", "word", (F.col("end") - F.char_length("value")).cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        "value", F.when(F.size("nearest") >= 2, context).alias("context"),
    )


def _trimmed(tokens: DataFrame) -> DataFrame:
    """Tokens without the punctuation around them."""
    lead = F.char_length(F.regexp_extract("value", f"^{LEAD}*", 0))
    core = F.regexp_replace(F.regexp_replace("value", f"^{LEAD}+", ""), f"{TRAIL}+$", "")
    tokens = tokens.withColumn("start", F.col("start") + lead).withColumn("value", core)
    return tokens.withColumn("end", F.col("start") + F.char_length("value")).where("value <> ''")


def _plain_followers(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, plain): how many different words without digit or at sign follow each context in ``texts``."""
    contexts = contexts.select("context", F.xxhash64("context").alias("pair"))
    if is_small(contexts, BROADCAST_PATTERNS):
        contexts = F.broadcast(contexts)
    words = F.split(_opened(F.regexp_replace("text", r"^\s+|\s+$", "")), r"\s+")
    after = F.transform(
        F.sequence(F.lit(1), F.size("words") - 2),
        lambda i: F.struct(F.xxhash64(F.array_join(F.slice("words", i, 2), " ")).alias("pair"), F.get("words", i + 1).alias("next")),
    )
    rows = texts.where("text IS NOT NULL").select(words.alias("words")).where("size(words) > 2")
    found = rows.select(F.inline(after)).join(contexts, "pair").where(~_may_hold(F.col("next")))
    found = found.select("context", F.xxhash64(F.regexp_replace("next", f"{TRAIL}+$", "")).alias("next")).distinct()
    return found.groupBy("context").agg(F.count("next").alias("plain"))


def _shapes(value: str) -> Column:
    """The kinds for which a value has the look."""
    return F.array_compact(F.array(*[F.when(F.col(value).rlike(shape), F.lit(kind)) for kind, shape in SHAPES.items()]))


def discovered(docs: DataFrame, texts: DataFrame, base: DataFrame, tokens: DataFrame) -> DataFrame:
    """(value, kind): tokens that trusted contexts mark as identifiers of a kind.

    All instances with digits are in ``base`` and ``tokens``; plain followers are first counted in ``texts``, the few
    that hold digits. Contexts that cannot be trusted after that, because all their tokens together are too few among
    these instances, need no count in ``docs``.
    """
    seeds = base.select(F.col("context"), F.col("value"), "kind").where("context IS NOT NULL").distinct()
    unknown = tokens.where("context IS NOT NULL").select("context", "value", F.explode(_shapes("value")).alias("kind"))
    edges = seeds.withColumn("seed", F.lit(True)).unionByName(unknown.distinct().withColumn("seed", F.lit(False)))
    edges = stored(edges.groupBy("context", "value", "kind").agg(F.max("seed").alias("seed")), "pattern-graph")
    nothing = edges.select("value", "kind").limit(0)
    if edges.where("NOT seed").isEmpty():
        return nothing
    usable = edges.groupBy("context", "kind").agg(F.countDistinct("value").alias("_n")).where(F.col("_n") >= LEAST_SUPPORT)
    usable = usable.groupBy("context").agg(F.max("_n").alias("_n"))
    instances = base.select("context", "value").unionByName(tokens.select("context", "value")).where("context IS NOT NULL")
    instances = instances.distinct().groupBy("context").agg(F.count("value").alias("instances"))
    usable = usable.join(instances, "context").where(F.col("_n") >= LEAST_CONFIDENCE * F.col("instances"))
    usable = stored(usable, "usable-contexts")
    here = _plain_followers(texts, usable.select("context"))
    everything = F.col("instances") + F.coalesce("plain", F.lit(0))
    contexts = usable.join(here, "context", "left").where(F.col("_n") >= LEAST_CONFIDENCE * everything).select("context", "instances")
    contexts = stored(contexts, "contexts")
    if contexts.isEmpty():
        return nothing
    plain = _plain_followers(docs, contexts.select("context"))
    followers = stored(contexts.join(plain, "context", "left").select("context", everything.alias("followers")), "followers")
    edges = stored(edges.join(followers, "context"), "scored-graph")
    seeds = stored(edges.where("seed").select("value", "kind").distinct().withColumn("trust", F.lit(1.0)), "seeds")
    known = seeds
    for _ in range(ROUNDS):
        trusted = edges.join(known, ["value", "kind"])
        patterns = trusted.groupBy("context", "kind").agg(
            F.countDistinct("value").alias("support"), (F.sum("trust") / F.max("followers")).alias("confidence")
        )
        patterns = patterns.where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE))
        new = (
            edges.where("NOT seed").join(patterns.select("context", "kind", "confidence"), ["context", "kind"])
            .groupBy("value", "kind").agg(F.least(F.lit(1.0), F.max("confidence")).alias("trust"))
        )
        known = stored(seeds.unionByName(new).groupBy("value", "kind").agg(F.max("trust").alias("trust")), "known")
    return known.join(seeds.select("value", "kind"), ["value", "kind"], "left_anti").select("value", "kind")


def find_spans(docs: DataFrame) -> DataFrame:
    """(text_key, size, base, spans) for each distinct text of ``docs`` that holds personal data: arrays of
    (start, kind number, end, kind), sorted."""
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = docs.where(_may_hold(F.col("text"))).select(*text_key(F.col("text")), "text")
    texts = stored(texts.groupBy("text_key", "size").agg(F.any_value("text").alias("text")), "texts-with-digits")
    at = ["text_key", "size"]
    spaced = (F.col("kind") != "run") | (F.col("value").contains(" ") & (F.size(_shapes("value")) > 0))
    found = stored(_matches(texts, {**PATTERNS, "token": TOKEN, "run": RUN}).where(spaced), "matches")
    # Every match starts in a word that is a token, and has its context.
    words = found.where("kind = 'token'").select(*at, "word", "context").where("context IS NOT NULL")
    base = found.where(F.col("kind").isin(*KINDS)).where(_valid(F.col("kind"), F.col("value"))).drop("context")
    base = stored(base.join(words, [*at, "word"], "left"), "fixed")
    tokens = _trimmed(found.where("kind = 'token'"))
    alike = tokens.where(F.size(_shapes("value")) > 0).select(*at, "word").distinct()
    runs = found.where("kind = 'run'").drop("context").join(alike, [*at, "word"], "left_anti").join(words, [*at, "word"], "left")
    tokens = tokens.unionByName(_trimmed(runs))
    covered = base.select("text_key", "size", F.col("start").alias("_s"), F.col("end").alias("_e"))
    touching = tokens.join(covered, at).where("start < _e AND _s < end").select(*at, "start", "end").distinct()
    free = tokens.join(touching, [*at, "start", "end"], "left_anti")
    # A word that begins a run is no instance of its own.
    begun = free.where("kind = 'run'").select(*at, "word", F.lit("token").alias("kind")).distinct()
    free = stored(free.join(begun, [*at, "word", "kind"], "left_anti").drop("kind"), "tokens")
    new = free.join(discovered(docs, texts, base, free), "value")
    number = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    entry = F.struct("start", number.alias("number"), "end", "kind")
    every = base.select(*at, "kind", "start", "end", F.lit(True).alias("fixed")).unionByName(
        new.select(*at, "kind", "start", "end", F.lit(False).alias("fixed"))
    )
    return every.groupBy(*at).agg(
        F.array_sort(F.collect_list(F.when(F.col("fixed"), entry))).alias("base"), F.array_sort(F.collect_list(entry)).alias("spans")
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs`` (doc_id, text).

    The counts are those of the fixed patterns. A null text counts as empty. Equal texts are judged once, repeated
    rows and null ids are kept, other columns are ignored.
    """
    spans = stored(find_spans(docs), "spans")  # read as a table, so that the join can split a hot text
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    rows = docs.select("doc_id", *text_key(F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.join(spans, ["text_key", "size"], "left")
    base = F.coalesce("base", none)

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.coalesce("spans", none)).alias("spans")
    )


def masked(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by its kind in brackets; spans that overlap
    become one. Other columns stay as they are.

    A null text stays null, an empty one empty. Repeated rows and rows without id are masked like all others; no row
    gives none.
    """
    own_key, own_size, span_key, span_size, found = unused(docs, "key", "size", "span_key", "span_size", "spans")
    spans = stored(find_spans(docs), "spans")
    spans = spans.select(F.col("text_key").alias(span_key), F.col("size").alias(span_size), F.col("spans").alias(found))
    key, size = text_key(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumns({own_key: key, own_size: size})
    rows = rows.join(spans, (F.col(own_key) == F.col(span_key)) & (F.col(own_size) == F.col(span_size)), "left")
    text = F.col("text")

    def step(done: Column, span: Column) -> Column:
        cut = F.concat(done["out"], text.substr(done["at"] + 1, span["start"] - done["at"]), F.lit("["), F.upper(span["kind"]), F.lit("]"))
        out = F.when(span["start"] < done["at"], done["out"]).otherwise(cut)
        return F.struct(out.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rebuilt = F.aggregate(found, start, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.char_length(text))))
    whole = F.when(F.col(found).isNull(), text).otherwise(rebuilt)
    return rows.select(*[whole.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])
