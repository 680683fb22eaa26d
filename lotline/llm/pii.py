"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, maybe_among, written

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive quantifiers and look-behinds keep them linear on
#: long runs: a match can only begin where its first run of characters does, or
#: where the last match ended (\G).
REGEX = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to be tried.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words that may be identifiers, with a digit or "@", one or several with a blank between.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: The words before a candidate that its context is taken from.
NEAR = r"(?<!\S)(?:\S++\s++){1,4}+\z"
#: Rounds of scoring; the score that makes a pattern trusted or an instance a seed of further patterns; the distinct seeds that a pattern needs.
ROUNDS, TRUSTED, SEEDS = 3, 0.5, 3
#: Elements of an array that are summed at once, and characters of a piece of a text that is cut.
BLOCK, PIECE = 256, 512


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern is one of its kind."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$")))
    if kind == "card":
        d = _digits(m)
        return F.when((F.length(d) >= 13) & (F.length(d) <= 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _matched(df: DataFrame, name: str, text: str, regex: str, hint: Column) -> DataFrame:
    """Adds m_<name>, the matches, g_<name>, the text between them, and s_<name>, where each starts.

    Starts are sums of lengths in blocks, so a text of n matches takes about
    BLOCK * n steps.
    """
    m, g, n, c, s = (f"{x}_{name}" for x in "mgncs")
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(hint, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, regex, -1)).otherwise(F.array(text)))
    df = df.withColumn(n, F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long")))
    zero = F.lit(0).cast("long")
    total = lambda arr: F.aggregate(arr, zero, lambda a, b: a + b)
    df = df.withColumn(c, F.aggregate(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), F.array(zero), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + total(F.slice(n, k * BLOCK + 1, F.lit(BLOCK)))))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return df.withColumn(s, F.transform(m, lambda x, i: F.get(c, block(i)) + total(F.slice(n, block(i) * BLOCK + 1, i % BLOCK)) + F.length(F.get(g, i)))).drop(n, c)


def _hint(kind: str, text: str) -> Column:
    return F.contains(F.col(text), F.lit(HINT[kind])) if HINT[kind] else F.rlike(F.col(text), F.lit("[0-9]"))


def _context(gap: Column, before: Column) -> Column:
    """The last two of the four words before a candidate that hold letters or digits, lower-cased, without marks, digits as 0."""
    near = F.lower(F.regexp_extract(F.concat(F.coalesce(before, F.lit("")), gap), NEAR, 0))
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(near, "[0-9]+", "0"), r"[^\p{L}\p{N}\s]+", " "), r"\s+"), lambda w: w != "")
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))


def _base(number: int, kind: str) -> Column:
    s = f"s_{kind}"
    each = F.transform(f"m_{kind}", lambda x, j: F.struct(F.lit(number).alias("kind"), F.get(s, j).alias("s"), (F.get(s, j) + F.length(x)).alias("e"), x.alias("entity")))
    return F.filter(each, lambda b: valid(kind, b["entity"]))


def _with_base(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Adds base, the base spans of t as an array of (kind, s, e, entity), by kind and start; none where not asked."""
    spans = []
    for i, kind in enumerate(KINDS):
        hint = _hint(kind, "t")
        df = _matched(df, kind, "t", REGEX[kind], hint if where is None else where & hint)
        df = df.withColumn(f"b_{kind}", _base(i, kind)).drop(f"m_{kind}", f"s_{kind}", f"g_{kind}")
        spans.append(f"b_{kind}")
    return df.withColumn("base", F.concat(*spans)).drop(*spans)


def _told(text: Column) -> list[Column]:
    """Two hashes that tell a text."""
    return [F.xxhash64(text).alias("told"), F.xxhash64(F.lit(11), text).alias("told2")]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: its base spans and its candidate words with their contexts, written; no texts.

    Columns: row (unique), key, told and told2 (hashes of the text), base (kind,
    s, e), words (nth, s, e, word, ctx, kind and entity of the base span that
    starts in the word, inner: the word lies in a base span that starts before it).
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = _with_base(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), *_told(t), t.alias("t")))
    df = _matched(df, "w", "t", CANDIDATE, F.rlike("t", F.lit("[0-9@]")))
    head = lambda x: F.length(F.regexp_extract(x, r"^[(\[{'\"<]*", 0))
    tail = lambda x: F.length(F.regexp_extract(x, r"[.,;:!?)\]}'\">]*$", 0))
    bare = F.transform("m_w", lambda x, i: F.struct(i.alias("nth"), (F.get("s_w", i) + head(x)).alias("s"), F.greatest(F.get("s_w", i) + F.length(x) - tail(x), F.get("s_w", i) + head(x)).alias("e"), F.regexp_replace(x, r"^[(\[{'\"<]+|[.,;:!?)\]}'\">]+$", "").alias("word"), _context(F.get("g_w", i), F.get("m_w", i - 1)).alias("ctx"), F.get("s_w", i).alias("from"), (F.get("s_w", i) + F.length(x)).alias("to")))
    df = df.withColumn("bare", bare).drop("m_w", "g_w", "s_w")

    def told(w: Column) -> Column:
        first = F.get(F.filter("base", lambda b: (b["s"] >= w["from"]) & (b["s"] < w["to"])), F.lit(0))
        inner = F.exists("base", lambda b: (b["s"] < w["from"]) & (b["e"] > w["from"]))
        return F.struct(w["nth"].alias("nth"), w["s"].alias("s"), w["e"].alias("e"), w["word"].alias("word"), w["ctx"].alias("ctx"), first["kind"].alias("kind"), first["entity"].alias("entity"), inner.alias("inner"))

    df = df.withColumn("words", F.transform("bare", told)).withColumn("base", F.transform("base", lambda b: F.struct(b["kind"], b["s"], b["e"])))
    return written(df.drop("bare", "t"), "pii-scan")


def possible(word: Column) -> Column:
    """The kinds (as numbers) that a word outside base spans may be, by its form."""
    digits = F.length(_digits(word))
    plain = F.rlike(word, F.lit(r"^[0-9().+/\x20-]+$"))
    return F.filter(
        F.array(
            F.when(F.rlike(word, F.lit(r"^[^@\s]+@[^@\s]+$")), 0),
            F.when(F.rlike(word, F.lit(r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$")), 1),
            F.when(plain & digits.between(12, 19), 2),
            F.when(plain & digits.between(7, 15), 3),
        ),
        lambda k: k.isNotNull(),
    )


def _occurrences(scanned: DataFrame) -> DataFrame:
    """A row for each candidate word and each of its two patterns (last two words, last word)."""
    w = scanned.select("row", F.explode("words").alias("w")).where("not w.inner and size(w.ctx) > 0").select("row", "w.*")
    patterns = F.array_distinct(F.array(F.concat_ws(" ", "ctx"), F.concat(F.lit("* "), F.element_at("ctx", -1))))
    return w.withColumn("pattern", F.explode(patterns))


def trusted_patterns(scanned: DataFrame) -> DataFrame:
    """(pattern, kind, score) of the patterns that reach TRUSTED with SEEDS distinct seeds, written.

    The graph has an edge for each pattern and distinct instance. Seeds are base
    matches, of belief 1 in their kind. In each round a pattern's score is the
    mean belief of its instances, and the belief of an instance that is no seed,
    in each kind its form allows, the mean score of its patterns. An instance
    whose belief reaches TRUSTED counts as a seed in the next round, so patterns
    that are met with discovered identifiers only are learned too, ROUNDS
    generations far. All steps are grouped sums and joins on patterns or
    instances.
    """
    seen = _occurrences(scanned)
    seed = seen.where("kind is not null").select("pattern", F.col("entity").alias("instance"), "kind", F.lit(1.0).alias("fixed"))
    other = seen.where("kind is null").select("pattern", F.col("word").alias("instance"), F.explode_outer(possible(F.col("word"))).alias("kind"), F.lit(None).cast("double").alias("fixed"))
    edges = written(seed.unionByName(other).groupBy("pattern", "instance", "kind").agg(F.max("fixed").alias("fixed")), "pii-graph")
    degree = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    ties = written(edges.where("kind is not null").join(degree, "pattern"), "pii-edges")
    forget(edges)
    belief = scores = None
    for _ in range(ROUNDS + 1):
        told = ties.withColumn("belief", F.col("fixed")) if belief is None else ties.join(belief, ["instance", "kind"], "left").withColumn("belief", F.coalesce("fixed", "belief"))
        now = told.groupBy("pattern", "kind").agg(F.sum(F.coalesce("belief", F.lit(0.0))).alias("sum"), F.count_if(F.col("belief") >= TRUSTED).alias("seeds"), F.max("n").alias("n")).where(F.col("seeds") >= SEEDS)
        new = written(now.select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score")), "pii-scores")
        if scores is not None:
            forget(scores)
        scores = new
        belief = ties.where("fixed is null").join(scores, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.avg("score").alias("belief"))
    trusted = written(scores.where(F.col("score") >= TRUSTED), "pii-trusted")
    forget(ties, scores)
    return trusted


def discovered(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """(row, found): the spans (kind, s, e, nth) that trusted patterns add to documents.

    A word takes the kind of its best pattern. found is an array over one
    document's words.
    """
    able = _occurrences(scanned).where("kind is null and s < e").select("row", "nth", "s", "e", "pattern", F.explode(possible(F.col("word"))).alias("kind"))
    hits = able.join(trusted, ["pattern", "kind"]).groupBy("row", "nth", "s", "e").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return hits.groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e", "nth")).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda b: F.concat_ws(":", F.get(names, b["kind"]), b["s"].cast("string"), b["e"].cast("string"))), ",")


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in whole texts.

    Returns key, n_email, n_ip, n_card, n_phone (base spans), n_context (added
    spans), base_sha256 and spans (kind:start:end in code points, end exclusive,
    by kind as listed, then start). Null texts are empty; repeated rows are
    returned as often as they come.
    """
    scanned = scan(docs, key, text)
    full = scanned.select("row", "key", "base").join(discovered(scanned, trusted_patterns(scanned)), "row", "left")
    more = F.transform(F.coalesce("found", F.array().cast("array<struct<kind:int,s:bigint,e:bigint,nth:int>>")), lambda b: F.struct(b["kind"], b["s"], b["e"]))
    count = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return full.select(F.col("key").alias(key), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_context"))


def _between(a: Column, b: Column) -> Column:
    """The text from a to b, from its pieces."""
    first, last = (F.floor(x / PIECE).cast("int") for x in (a, b))
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    at = lambda x: (x % PIECE).cast("int")
    one = F.substring(piece(first), at(a) + 1, (b - a).cast("int"))
    more = F.concat(F.substring(piece(first), at(a) + 1, F.lit(PIECE)), F.array_join(F.slice("pieces", first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(piece(last), F.lit(1), at(b)))
    return F.when(first == last, one).otherwise(more)


def _cut(df: DataFrame) -> DataFrame:
    """t with its spans (kind, s, e, sorted by s) replaced by tags; overlapping ones by the tag of the first.

    The text is read in pieces, so a text of n characters and m spans takes about
    n + BLOCK * m steps.
    """
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    zero = F.lit(0).cast("long")
    most = lambda at, n: F.coalesce(F.array_max(F.slice("ends", at, n)), zero)
    df = df.withColumn("pieces", F.when(F.size("spans") > 0, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    df = df.withColumn("ends", F.transform("spans", lambda x: x["e"]))
    df = df.withColumn("blocks", F.aggregate(F.sequence(F.lit(0), F.floor(F.size("ends") / BLOCK).cast("int")), F.array(zero), lambda a, k: F.concat(a, F.array(F.greatest(F.element_at(a, -1), most(k * BLOCK + 1, F.lit(BLOCK)))))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    # where the spans before one end
    df = df.withColumn("begin", F.transform("spans", lambda x, i: F.greatest(F.get("blocks", block(i)), most(block(i) * BLOCK + 1, i % BLOCK))))
    parts = F.transform("spans", lambda x, i: F.when(F.get("begin", i) > x["s"], "").otherwise(F.concat(_between(F.get("begin", i), x["s"]), F.get(tags, x["kind"]))))
    end = F.element_at("blocks", -1)
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), _between(end, F.length("t").cast("long")))).otherwise(F.col("t"))
    return df.withColumn("t", text).drop("pieces", "ends", "blocks", "begin")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each base span and each discovered one, as extract() tells them, replaced by its kind's tag.

    A failing match may hide a neighbour (a card number right after an address),
    so the base patterns are tried once more on what is left of texts that had
    spans. All columns stay, whatever their names. Null texts stay null. The spans that
    contexts add are told by hashes of the texts that have some; only documents
    that may be among these are shuffled.
    """
    at = docs.columns.index(text)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    scanned = scan(rows.select(F.lit(0).alias("key"), f"c{at}"), "key", f"c{at}")
    trusted = trusted_patterns(scanned)
    found = written(discovered(scanned, trusted).join(scanned.select("row", "told", "told2"), "row").groupBy("told", "told2").agg(F.min("found").alias("found")), "pii-found")
    forget(scanned, trusted)
    plain = rows.withColumn("t", F.coalesce(f"c{at}", F.lit("")))
    asked = maybe_among(plain.select("*", *_told(F.col("t"))), F.col("told"), found.select("told").distinct())
    columns = [*rows.columns, "t"]
    none = F.lit(None).cast(found.schema["found"].dataType)
    both = asked.where("not __hit").select(*columns, none.alias("found")).unionByName(asked.where("__hit").join(found, ["told", "told2"], "left").select(*columns, "found"))
    more = F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda b: F.struct(b["s"], b["e"], b["kind"]))
    base = F.transform("base", lambda b: F.struct(b["s"], b["e"], b["kind"]))
    df = _cut(_with_base(both).withColumn("spans", F.array_sort(F.concat(base, more))).drop("base", "found"))
    df = _cut(_with_base(df, F.size("spans") > 0).withColumn("spans", F.array_sort(base)).drop("base"))
    # not deterministic (yet always true), so that no filter on the text is pushed down, where the text's expression would multiply
    fresh = F.when(F.col(f"c{at}").isNotNull() & (F.monotonically_increasing_id() >= 0), F.col("t"))
    return df.select(*(fresh.alias(c) if i == at else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
