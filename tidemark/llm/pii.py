r"""Personal data: base patterns, and bootstrapped contextual extraction of more identifiers.

Base spans are leftmost, non-overlapping matches of a kind's pattern that pass its test. Java's regex
engine recurses over a repeated group, so "digits with single separators" and "labels with dots"
are first made runs of one character class: the separators between digits (and the dots between domain
characters) are replaced by private characters of the same length. Places come from the gaps between
matches: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and lengths add up. Sums run in
blocks of the square root of their number, so that a text of a megabyte of numbers takes seconds.

Bootstrapping: candidates are words with a digit. Each has lexical patterns: the word before it (``L:``), the
two words before it (``D:``), the words on both sides (``B:``) and a key inside it (``K:``, as in
``login=``). Words that overlap a base span are the seeds. A pattern's score is the share of its
extractions that are known identifiers; extractions are the candidates that it stands with, and for ``L:`` all
occurrences of the word before, whatever follows, so common words score near 0. High-scoring
patterns with enough distinct known values make their other candidates, and those values wherever they
stand, known; this is repeated ``ROUNDS`` times over the graph of patterns and values.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import let
from tidemark.storage import durable, release

#: The kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: Kind of a span that context has found.
FOUND = "context"

#: Private characters that stand for a separator in a number and a dot in a name. In a text they
#: are replaced by OTHER beforehand; no pattern knows any of them.
SEPARATOR, DOT, OTHER = "\ue000", "\ue001", "\ue002"

PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{SEPARATOR}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind; it is cheaper to look for.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

#: Words with a digit: candidates for context. Shorter ones, or with fewer digits, aren't identifiers.
WORD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
MIN_CHARS, MIN_DIGITS = 6, 3
#: Characters next to a candidate in which its neighbour is looked for.
REACH = 64
ROUNDS = 3
MIN_VALUES, MIN_SCORE = 5, 0.5


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def running(values: Column, op) -> Column:
    """Running totals of an array of integers under ``op``, an associative function for which 0 changes nothing.

    Appending to an array copies it. Blocks of about the square root of the size keep that to n times its root.
    """
    zero = F.array().cast("array<int>")

    def over(p: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(p))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(p) / size).cast("int"), F.lit(1)) - 1), lambda i: F.slice(p, i * size + 1, size))
        inside = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: F.array_append(acc, op(F.coalesce(_last(acc), F.lit(0)), x))))

        def joined(t: Column) -> Column:
            before = F.aggregate(t, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, op(_last(acc), F.coalesce(_last(b), F.lit(0)))))
            return F.flatten(F.zip_with(t, F.slice(before, F.lit(1), F.size(t)), lambda b, k: F.transform(b, lambda x: op(k, x))))

        return let(inside, joined)

    return let(values, over)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, t, g, r) of all matches: start and end in code points, text, the gaps before and after."""

    def placed(gaps: Column) -> Column:
        own = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        both = F.zip_with(own, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))), lambda x, r: F.struct(x["m"].alias("m"), x["g"].alias("g"), r.alias("r")))
        # There is one gap more than matches; it pairs with no match and adds nothing.
        real = F.filter(both, lambda x: x["m"].isNotNull())

        def ends(p: Column) -> Column:
            until = running(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda a, x: a + x)
            return F.zip_with(p, until, lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("t"), x["g"].alias("g"), x["r"].alias("r")))

        return let(real, ends)

    return let(F.split(text, pattern, -1), placed)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    d = F.reverse(_digits(t))
    one = lambda i: F.ascii(F.substring(d, i.cast("int"), F.lit(1))) - 48
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(one(i))).otherwise(one(i)))
    return F.length(d).between(12, 19) & (F.when(F.length(d).between(12, 19), total).otherwise(1) % 10 == 0)


def _small(part: Column) -> Column:
    """Whether a number of any length is at most 255."""
    p = F.regexp_replace(part, "^0+", "")
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


TESTS = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: F.forall(F.split(t, r"\."), _small),
    "card": _luhn,
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
}


def _passes(test):
    return lambda m: test(m["t"])


def _placed(o: int):
    return lambda m: F.struct(m["s"].alias("s"), F.lit(o).alias("o"), m["e"].alias("e"))


def base_spans(text: Column) -> Column:
    """Array of (s, o, e): start, place of the kind in KINDS, end; sorted."""
    plain = F.translate(text, SEPARATOR + DOT, OTHER + OTHER)
    view = {
        "email": F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT),
        "card": F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", SEPARATOR),
    }
    none = F.array().cast("array<struct<s:int,o:int,e:int>>")
    parts = []
    for o, k in enumerate(KINDS):
        good = F.filter(_matches(view.get(k, plain), PATTERNS[k]), _passes(TESTS[k]))
        parts.append(F.when(text.rlike(NEEDS[k]), F.transform(good, _placed(o))).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, FOUND)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


CANDIDATE = "struct<s:int,e:int,v:string,left:string,two:string,right:string,key:string,seed:boolean>"


def _candidates(text: Column, base: Column) -> Column:
    """Array of CANDIDATE: words with a digit, without outer punctuation; ``seed`` if a base span overlaps."""
    before = lambda g, n: F.regexp_replace(F.regexp_extract(F.right(g, F.lit(REACH)), rf"(?:^|\s)(\S+(?:\s+\S+){{{n - 1}}})\s*$", 1), r"\s+", " ")

    def one(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["t"], r"^([\p{Punct}&&[^+]]*)", 1))
        core = F.regexp_replace(F.substring(x["t"], lead + 1, F.length(x["t"])), r"[\p{Punct}]+$", "")
        key = F.lower(F.regexp_extract(core, r"^([A-Za-z][A-Za-z0-9_.-]{0,40}[=:])", 1))
        body = F.substring(core, F.length(key) + 1, F.length(core))
        start = x["s"] + lead + F.length(key)
        right = F.lower(F.regexp_extract(F.left(x["r"], F.lit(REACH)), r"^\s*(\S+)", 1))
        return F.struct(start.alias("s"), (start + F.length(body)).alias("e"), F.lower(body).alias("v"), F.lower(before(x["g"], 1)).alias("left"), F.lower(before(x["g"], 2)).alias("two"), right.alias("right"), key.alias("key"))

    words = F.filter(F.transform(_matches(text, WORD), one), lambda x: (F.length(x["v"]) >= MIN_CHARS) & (F.length(_digits(x["v"])) >= MIN_DIGITS))
    return let(words, lambda c: F.zip_with(c, overlapping(c, base), lambda x, hit: x.withField("seed", hit)))


def overlapping(words: Column, base: Column) -> Column:
    """For each word whether a base span begins before its end and ends after its start: one pass over both in order."""
    event = "array<struct<at:int,kind:int,far:int,i:int>>"
    spans = F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("kind"), b["e"].alias("far"), F.lit(-1).alias("i"))).cast(event)
    ends = F.transform(words, lambda w, i: F.struct(w["e"].alias("at"), F.lit(0).alias("kind"), w["s"].alias("far"), i.alias("i"))).cast(event)

    def hits(events: Column) -> Column:
        until = running(F.transform(events, lambda x: F.when(x["kind"] == 1, x["far"]).otherwise(0)), lambda a, x: F.greatest(a, x))
        asked = F.zip_with(events, until, lambda x, far: F.struct(x["i"].alias("i"), (far > x["far"]).alias("hit")))
        return F.transform(F.array_sort(F.filter(asked, lambda x: x["i"] >= 0)), lambda x: x["hit"])

    return let(F.array_sort(F.concat(spans, ends)), hits)


def _patterns() -> Column:
    """Array of the patterns that a candidate stands with."""
    named = lambda tag, some, *parts: F.when(some, F.concat_ws("|", F.lit(tag), *parts))
    left, two, right, key = (F.col(x) for x in ("left", "two", "right", "key"))
    return F.array_compact(F.array(named("L:", left != "", left), named("D:", two != "", two), named("B:", (left != "") & (right != ""), left, right), named("K:", key != "", key)))


def bootstrap(occurrences: DataFrame, words: DataFrame) -> DataFrame:
    """``uid, s, e`` of candidates that context makes known and that no base span overlaps.

    ``occurrences`` has ``uid`` and the fields of CANDIDATE; ``words`` the count ``n`` of each ``word``
    that occurs anywhere.
    """
    pattern = F.explode(_patterns())
    # One row for each pattern and value: partial aggregates, so a frequent pattern isn't a large group.
    graph = durable(occurrences.select("v", pattern.alias("p"), "seed").groupBy("p", "v").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("int")).alias("seed")))
    total = graph.groupBy("p").agg(F.sum("n").alias("own"))
    left = words.select(F.concat_ws("|", F.lit("L:"), "word").alias("p"), F.col("n").alias("all"))
    total = durable(total.join(left, "p", "left").select("p", F.greatest("own", F.coalesce("all", "own")).alias("all")))
    known = durable(graph.groupBy("v").agg(F.max("seed").alias("known")).where("known = 1").select("v"))
    patterns = None
    for _ in range(ROUNDS):
        release(patterns)
        hits = graph.join(known, "v").groupBy("p").agg(F.sum("n").alias("hits"), F.count("*").alias("values"))
        patterns = durable(hits.join(total, "p").where((F.col("values") >= MIN_VALUES) & (F.col("hits") >= MIN_SCORE * F.col("all"))).select("p"))
        more = durable(graph.join(patterns, "p").select("v").unionByName(known).distinct())
        release(known)
        known = more
    found = occurrences.where("not seed").join(known, "v").select("uid", "s", "e").distinct()
    release(total)
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id_col``, ``base`` and ``found``, arrays of spans (s, o, e).

    ``o`` is the kind's place in KINDS, or ``len(KINDS)`` for what context has found. A null text
    counts as empty and has no spans. Rows are answered one by one, repeated rows and null ids too; but all
    of them teach the patterns. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    none = F.array().cast(f"array<{CANDIDATE}>")
    based = rows.select("id", "t", base_spans(F.col("t")).alias("base"))
    found = F.when(F.col("t").rlike("[0-9]"), _candidates(F.col("t"), F.col("base")).cast(f"array<{CANDIDATE}>")).otherwise(none)
    seen = durable(based.select("id", "base", found.alias("cand")).withColumn("uid", F.monotonically_increasing_id()))
    occurrences = seen.select("uid", F.explode("cand").alias("c")).select("uid", "c.*")
    words = rows.select(F.explode(F.split(F.lower("t"), r"\s+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    found = bootstrap(occurrences, words).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("o"), "e"))).alias("found"))
    empty = F.array().cast("array<struct<s:int,o:int,e:int>>")
    return seen.join(found, "uid", "left").select(F.col("id").alias(id_col), "base", F.coalesce("found", empty).alias("found"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda o: F.size(F.filter("base", lambda x: x["o"] == o)).cast("long")
    return out.select(
        "doc_id",
        *(count(o).alias(f"n_{k}") for o, k in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
