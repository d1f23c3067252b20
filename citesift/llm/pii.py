r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: e-mail addresses, IPv4 addresses, card and phone numbers by their form (fixed patterns,
   confirmed by value ranges, digit counts and the Luhn sum), and secrets: long mixed values that are
   assigned to a name (kind ``secret``, not among the base kinds).
2. Candidates: other tokens of six characters or more with at least two digits (``CANDIDATE``).
3. Lexical patterns: the last word, and the last two words, in front of a seed or candidate, if seeds
   follow them much more often than chance (``MIN_LIFT``).
4. The graph of patterns and the values they introduce is scored. A pattern that has introduced ``MIN_SEEDS``
   different seeds has as confidence the summed belief in its values over their number plus
   ``DOUBT``. The belief in a seed is 1, in a candidate ``DAMPING`` times its weight times the confidence of its
   best pattern; the weight is 1 for the shape of an identifier (``SHAPE``), else ``PLAIN``. As the damping makes
   every round a contraction, there is one fixed point, and rounds go on until nothing moves by ``TOLERANCE``, without a cap.
   With s seeds and u candidates of its own a pattern ends at s / (s + DOUBT + u (1 - DAMPING)): unknown
   values count against it, smoothly.
5. Candidates whose weight times confidence reaches ``CONFIDENT`` are identifiers (kind ``learned``): those of
   an identifier's shape wherever they occur, others (mere numbers, short codes) behind the pattern only.

Not found: identifiers without a digit (user names), of several words, or behind their value's right side only.

Work: the forms are looked for in texts with a digit or an at sign only, in one pass; texts are never
shuffled, only values with their contexts. Expressions are possessive and start at word or number
starts, so that long texts without spaces take linear time.

Defined cases: NULL and empty texts have no spans; equal rows get equal spans each; a corpus
without seeds or candidates has no patterns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.frames import column, small, stored

KINDS = ["email", "ip", "card", "phone"]
SECRET, LEARNED = "secret", "learned"
ALL_KINDS = [*KINDS, SECRET, LEARNED]
DOUBT = 1.0
DAMPING = 0.9
PLAIN = 0.9
TOLERANCE = 1e-4
MIN_SEEDS = 3
MIN_LIFT = 3
CONFIDENT = 0.75
TAIL_CHARS = 80
CHUNK = 256

# Fixed patterns, in their linear forms.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A word with a digit in it, found from the start of the word.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
# Marks around a token that are not part of it.
EDGES_LEFT, EDGES_RIGHT = r"^[(\[{\"'<,;:]+", r"[)\]}\"'>.,;:!?]+$"
CANDIDATE = r"^(?=(?:[^0-9]*+[0-9]){2})(?=.{6})"
# Weighs fully: eight characters or more, two digits and a letter.
SHAPE = r"^(?=(?:[^0-9]*+[0-9]){2})(?=[^A-Za-z]*+[A-Za-z])(?=.{8})"
# A value that is assigned to a name, in its own token or in front of it: 20 characters or more, four digits, four letters.
ASSIGNED = r"[=:][\x20\x09-\x0D]*$"
NAME = r"^[A-Za-z_][A-Za-z0-9_.-]*+[=:]"
QUOTE = r"^[\"'`]"
SECRET_VALUE = r"^[A-Za-z0-9][A-Za-z0-9_+/=-]{19,}+"
MIXED = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})"
IP_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,tail:string>"


def _found(text: Column, form: str, possible: Column) -> Column:
    """Gaps and hits of a pattern: array of (gap length, last characters of the gap, hit)."""
    hits = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    gaps = F.slice(F.split(text, form, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(
        gaps,
        hits,
        lambda g, h: F.struct(
            F.length(g).cast("bigint").alias("gap"), F.right(g, F.lit(TAIL_CHARS)).alias("tail"), h.alias("hit")
        ),
    )
    return F.when(possible, pairs).otherwise(
        F.array().cast("array<struct<gap:bigint,tail:string,hit:string>>")
    )


def _placed(pairs: str, kind: int) -> Column:
    """Spans from gaps and hits: running sums of lengths, in chunks so that long lists stay linear.

    ``pairs`` must name a column, as it is read once per chunk.
    """
    found = F.col(pairs)
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    part = lambda c: F.slice(found, c * CHUNK + 1, F.lit(CHUNK))
    zero = F.lit(0).cast("bigint")
    width = lambda at, x: at + x["gap"] + F.length(x["hit"])
    empty = F.array().cast(f"array<{SPAN}>")

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            (start + F.length(x["hit"])).alias("end"),
            x["hit"].alias("value"),
            x["tail"].alias("tail"),
        )
        return F.struct(
            (start + F.length(x["hit"])).alias("at"), F.concat(state["out"], F.array(span)).alias("out")
        )

    def spans(state: Column, c: Column) -> Column:
        inside = F.aggregate(
            part(c), F.struct(state["at"].alias("at"), empty.alias("out")), place, lambda s: s["out"]
        )
        return F.struct(
            F.aggregate(part(c), state["at"], width).alias("at"),
            F.concat(state["lists"], F.array(inside)).alias("lists"),
        )

    start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("lists"))
    return F.when(F.size(found) == 0, empty).otherwise(
        F.flatten(F.aggregate(chunks, start, spans, lambda s: s["lists"]))
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(IP_PART))
    n = F.length(digits(value))
    if kind == "phone":
        return n.between(9, 15)
    # Other lengths never reach the sum.
    return F.when(n.between(12, 19), luhn(digits(value))).otherwise(F.lit(False))


def _is_valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, base, secrets, candidates``: one row per row of ``docs``, spans in code points.

    ``base`` has the seeds of the base kinds in order of start and kind, ``secrets`` the assigned values;
    ``candidates`` the other tokens that may be identifiers and touch no seed. All carry the characters in
    front of them.
    """
    body = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(column(doc).alias("doc_id"), body.alias("body"))
    rows = rows.select("doc_id", "body", F.xxhash64("body").alias("text_key"))
    body = F.col("body")
    number, at = body.rlike("[0-9]"), F.contains(body, F.lit("@"))
    possible = {"email": at, "ip": number, "card": number, "phone": number & F.contains(body, F.lit("+"))}
    pairs = [_found(body, FORMS[k], possible[k]).alias(k) for k in KINDS]
    rows = rows.select("doc_id", "text_key", *pairs, _found(body, TOKEN, number).alias("token"))
    spans = [F.filter(_placed(k, i), _is_valid(k)).alias(k) for i, k in enumerate(KINDS)]
    token = _placed("token", ALL_KINDS.index(LEARNED)).alias("token")
    rows = rows.select("doc_id", "text_key", *spans, token)
    base = F.array_sort(F.concat(*KINDS), _by_place)
    secrets = F.filter(F.transform("token", _assigned), lambda t: t["value"].rlike(MIXED))
    rows = rows.select("doc_id", "text_key", base.alias("base"), secrets.alias("secrets"), "token")
    trimmed = F.transform("token", _trim)

    def touched(t: Column) -> Column:
        return F.exists(F.concat("base", "secrets"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    free = F.filter(trimmed, lambda t: t["value"].rlike(CANDIDATE) & ~touched(t))
    return rows.select("doc_id", "text_key", "base", "secrets", free.alias("candidates"))


def _by_place(a: Column, b: Column) -> Column:
    first = F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
    return F.coalesce(first, F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))


def _trim(span: Column) -> Column:
    """A token without the marks around it."""
    left = F.regexp_replace(span["value"], EDGES_LEFT, "")
    value = F.regexp_replace(left, EDGES_RIGHT, "")
    start = span["start"] + F.length(span["value"]) - F.length(left)
    return F.struct(
        start.alias("start"),
        span["kind"].alias("kind"),
        (start + F.length(value)).alias("end"),
        value.alias("value"),
        span["tail"].alias("tail"),
    )


def _assigned(span: Column) -> Column:
    """The value that a token gives to a name, as a span; with an empty value if there is none."""
    token = span["value"]
    own = F.regexp_replace(token, NAME, "")
    named = (F.length(own) < F.length(token)) | span["tail"].rlike(ASSIGNED)
    bare = F.regexp_replace(own, QUOTE, "")
    value = F.when(named, F.regexp_extract(bare, SECRET_VALUE, 0)).otherwise(F.lit(""))
    start = span["start"] + F.length(token) - F.length(bare)
    return F.struct(
        start.alias("start"),
        F.lit(ALL_KINDS.index(SECRET)).alias("kind"),
        (start + F.length(value)).alias("end"),
        value.alias("value"),
        span["tail"].alias("tail"),
    )


def weight(value: Column) -> Column:
    """How much of its pattern's confidence a candidate may have."""
    return F.when(value.rlike(SHAPE), 1.0).otherwise(PLAIN)


def _front(spans: DataFrame) -> DataFrame:
    """``tail`` as ``words``, in lower case, without a word that may be cut."""
    words = F.filter(F.split(F.lower("tail"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # A tail of full length may begin inside a word.
    cut = F.when(F.length("tail") < TAIL_CHARS, 1).otherwise(2)
    rows = spans.withColumn("words", words).withColumn("cut", cut).drop("tail")
    return rows.withColumn("words", F.slice("words", F.col("cut"), F.size("words"))).drop("cut")


def _grams(words: str) -> Column:
    """Words and neighbouring pairs; ``intro`` marks the ones that stand right in front."""
    n = F.size(words)
    single = F.transform(words, lambda w, i: F.struct(w.alias("pattern"), (i == n - 1).alias("intro")))
    pairs = F.transform(
        F.slice(words, F.lit(2), n),
        lambda w, i: F.struct(
            F.concat(F.get(words, i), F.lit(" "), w).alias("pattern"), (i == n - 2).alias("intro")
        ),
    )
    return F.concat(single, pairs)


def occurrences(scanned: DataFrame) -> DataFrame:
    """``value, seed, pattern``: every telling pattern in front of a value, each pair once.

    A pattern is telling if seeds follow it ``MIN_LIFT`` times as often as it stands anywhere else in
    the text before seeds and candidates: "card" is, "the" is not.
    """
    both = scanned.select(F.explode(F.concat("base", "secrets", "candidates")).alias("s")).select(
        "s.value", "s.tail", (F.col("s.kind") != ALL_KINDS.index(LEARNED)).alias("seed")
    )
    both = _front(both)
    rows = both.select("value", "seed", F.explode(_grams("words")).alias("gram")).select("value", "seed", "gram.*")
    folded = rows.groupBy("pattern", "value", "seed", "intro").agg(F.count(F.lit(1)).alias("n"))
    folded = stored(folded, "pii-grams")
    follows = F.sum(F.when(F.col("intro") & F.col("seed"), F.col("n")).otherwise(0))
    elsewhere = F.sum(F.when(F.col("intro"), 0).otherwise(F.col("n")))
    n_follows, n_elsewhere = folded.agg(follows, elsewhere).first()
    counts = folded.groupBy("pattern").agg(follows.alias("follows"), elsewhere.alias("elsewhere"))
    telling = counts.where(
        (F.col("follows") >= MIN_SEEDS)
        & (F.col("follows") * ((n_elsewhere or 0) + 1.0) >= MIN_LIFT * (F.col("elsewhere") + 1) * (n_follows or 1))
    ).select("pattern")
    edges = folded.where("intro").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    return edges.join(telling, "pattern")


def confidences(edges: DataFrame) -> DataFrame:
    """``pattern, confidence`` at the fixed point, for ``edges`` of ``pattern, value, seed``."""
    edges = stored(edges.withColumn("weight", weight(F.col("value"))), "pii-edges")
    unknown = F.when(F.col("seed"), 0.0).otherwise(DAMPING * F.col("weight"))
    counts = edges.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("seed").cast("int")).alias("seeds"),
        F.sum(unknown).alias("own"),
    )
    counts = counts.where(F.col("seeds") >= MIN_SEEDS)
    # Exact for patterns that share no candidate, and a lower bound for others.
    alone = F.col("seeds") / (F.col("n") + DOUBT - F.col("own"))
    scores = stored(counts.select("pattern", "n", "seeds", alone.alias("confidence")), "pii-patterns")
    candidates = edges.where(~F.col("seed")).select("pattern", "value", "weight")
    moved = scores.isEmpty() or candidates.isEmpty()
    while not moved:
        best = candidates.join(scores, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        beliefs = candidates.join(best, "value").groupBy("pattern")
        beliefs = beliefs.agg(F.sum(DAMPING * F.col("weight") * F.col("best")).alias("belief"))
        confidence = (F.col("seeds") + F.coalesce("belief", F.lit(0.0))) / (F.col("n") + DOUBT)
        after = scores.join(beliefs, "pattern", "left").select(
            "pattern", "n", "seeds", confidence.alias("confidence"), F.abs(confidence - F.col("confidence")).alias("step")
        )
        after = stored(after, "pii-patterns")
        moved = after.agg(F.max("step")).first()[0] < TOLERANCE
        scores = after.drop("step")
    return scores.select("pattern", "confidence")


def _counted(df: DataFrame, name: str) -> DataFrame:
    """A stored table with the string ``name``, marked for broadcast if its bytes are few."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(name))).first()
    return small(df, 1, 32 * n + (size or 0))


def personal_data(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``: seeds of the base kinds, and all seeds with learned identifiers, in order."""
    scanned = stored(scan(docs, doc, text), "pii-spans")
    edges = occurrences(scanned)
    patterns = stored(confidences(edges).where(F.col("confidence") >= CONFIDENT), "pii-confident")
    shaped = edges.where(~F.col("seed") & F.col("value").rlike(SHAPE))
    known = stored(shaped.join(patterns, "pattern", "left_semi").select("value").distinct(), "pii-learned")
    telling = patterns.where(PLAIN * F.col("confidence") >= CONFIDENT).select("pattern")

    tokens = scanned.select("doc_id", "text_key", F.explode("candidates").alias("span"))
    anywhere = tokens.where(F.col("span.value").rlike(SHAPE))
    hits = anywhere.join(_counted(known, "value"), F.col("span.value") == F.col("value"), "left_semi")
    behind = _front(tokens.where(~F.col("span.value").rlike(SHAPE)).withColumn("tail", F.col("span.tail")))
    behind = behind.select("doc_id", "text_key", "span", F.explode(_grams("words")).alias("gram"))
    behind = behind.where("gram.intro").withColumn("pattern", F.col("gram.pattern"))
    behind = behind.join(_counted(telling, "pattern"), "pattern", "left_semi").select(*tokens.columns)
    hits = hits.unionByName(behind)
    # Equal rows have equal spans: they count once here and are joined to each of the rows.
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("more"))
    hits = hits.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "more")
    none = F.array().cast(f"array<{SPAN}>")
    every = F.concat("base", "secrets", F.coalesce("more", none))
    return (
        scanned.join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
        .select("doc_id", "base", F.array_sort(every, _by_place).alias("spans"))
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: str, kind: str) -> Column:
    place = ALL_KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("bigint")
