"""Benchmark decontamination by a positional inverted index of the corpus.

For each window of test words the two rarest words (by their counts in the whole corpus) are anchors. The index stores
the postings of the anchors' terms: document, position and the words around it. Postings are intersected after their
place in the test item is taken off (all anchors of a copied passage fall on one diagonal); what is left, next to a word
that is next to it in the item, is compared word by word, for exact phrases. Proximity matches (near()) are looked up by runs of words
that no change of the words allowed can break, as a changed word may be the rarest. All of it is DataFrame expressions.

What is broadcast goes out in blocks of a bounded number of rows: a larger test set, or a term with more places in it, takes
more passes, not more memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A word, after A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ said by what it has, which is found several times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (terms, or places of terms in the test set) broadcast at once, a few MB.
TERMS_A_PASS = 200_000


def lowered(text: str) -> Column:
    """A-Z lower-cased and no other letters; the fast way where a text is ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str) -> Column:
    """The words of a text; none of null."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.expr("cast(array() AS array<string>)"))


def _items(items: DataFrame, window: int) -> DataFrame:
    """(item_id, item, words, w): an item of fewer words than a window is one window; one of none has no row."""
    d = items.select("item_id", C.row_key("item_id", "text").alias("item"), words("text").alias("words")).filter(F.size("words") > 0)
    return d.withColumn("w", F.least(F.lit(window), F.size("words"))).dropDuplicates(["item_id", "item"])


def _blocks(rows: DataFrame, terms_a_pass: int, by: tuple[str, ...] = ("term",)) -> list[DataFrame]:
    """rows in blocks of about terms_a_pass each, by a hash of `by`."""
    n = -(-rows.count() // terms_a_pass)
    return [rows.filter(F.pmod(F.xxhash64(*by), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else like.limit(0)


def term_counts(docs: DataFrame, terms: DataFrame, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """(term, n): occurrences in the corpus of each term; added up before the shuffle."""
    # Outer forms here and below: plain ones infer a filter on the array's size, for which the words would be found twice.
    tokens = docs.select(F.explode_outer(words("text")).alias("term"))
    parts = [tokens.join(F.broadcast(b), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")) for b in _blocks(terms, terms_a_pass)]
    return _union(parts, terms.select("term", F.lit(0).cast("long").alias("n")))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, item, w, j, term, before, after): places, and the words beside them, of the two rarest words of each window
    that may occur (all its words do)."""
    each = items.select("item_id", "item", "w", F.posexplode("words").alias("j", "term"))
    placed = each.join(counts, "term", "left").groupBy("item_id", "item", "w").agg(
        F.array_sort(F.collect_list(F.struct("j", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("at")
    )
    windows = placed.select(
        "item_id",
        "item",
        "w",
        F.explode(F.expr("transform(sequence(0, size(at) - w), s -> array_sort(transform(slice(at, s + 1, w), x -> named_struct('n', x.n, 'j', x.j, 'term', x.term))))")).alias("win"),
    ).filter("win[0].n > 0")
    places = windows.select("item_id", "item", "w", F.explode(F.slice("win", 1, 2)).alias("a")).select("item_id", "item", "w", "a.j", "a.term").distinct()
    words = items.select(F.col("item_id").alias("_id"), F.col("item").alias("_item"), "words")
    return places.join(words, (places["item"] == words["_item"]) & places["item_id"].eqNullSafe(words["_id"])).select(
        "item_id", "item", "w", "j", "term", F.expr("get(words, j - 1)").alias("before"), F.expr("get(words, j + 1)").alias("after")
    )


def postings(docs: DataFrame, places: DataFrame, window: int = 10, beside: bool = True, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """The positional index: (doc_id, doc, term, pos, left, near), near being the words up to window - 1 places either side.

    With `beside` only postings next to a word that is also next to the term in an item: all that a phrase needs.
    """
    r = window - 1
    tokens = docs.select("doc_id", C.row_key("doc_id", "text").alias("doc"), words("text").alias("_words")).select("doc_id", "doc", "_words", F.posexplode_outer("_words").alias("pos", "term"))
    near = F.expr(f"slice(_words, greatest(pos - {r}, 0) + 1, least(pos, {r}) + 1 + {r})").alias("near")
    terms = places.select(F.col("term").alias("_term"), "w", "before", "after").distinct() if beside else places.select(F.col("term").alias("_term")).distinct()
    on = F.expr("term = _term AND (w = 1 OR get(_words, pos - 1) = before OR get(_words, pos + 1) = after)") if beside else F.expr("term = _term")
    parts = [
        tokens.join(F.broadcast(b), on, "left_semi").select("doc_id", "doc", "term", "pos", F.least("pos", F.lit(r)).alias("left"), near)
        for b in _blocks(C.stored(terms, "anchor-terms"), terms_a_pass, tuple(terms.columns))
    ]
    found = _union(parts, tokens.select("doc_id", "doc", "term", "pos", F.lit(0).alias("left"), F.col("_words").alias("near")))
    # One posting may fit terms of several blocks.
    return found.dropDuplicates(["doc_id", "doc", "pos"]) if len(parts) > 1 else found


def build(docs: DataFrame, items: DataFrame, window: int = 10, beside: bool = True, terms_a_pass: int = TERMS_A_PASS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, anchors and the index of the corpus for them, each stored in the shared folder; proximity needs beside=False."""
    own = C.stored(_items(items, window), "items")
    terms = own.select(F.explode("words").alias("term")).distinct()
    counts = C.stored(term_counts(docs, terms, terms_a_pass), "term-counts")
    places = C.stored(anchors(own, counts), "anchors")
    return own, places, C.stored(postings(docs, places, window, beside, terms_a_pass), "postings")


def _placed(places: DataFrame, index: DataFrame, terms_a_pass: int, beside: bool = False) -> DataFrame:
    """Each posting at each place its term has as an anchor, with `beside` where a word next to it is the same; places go out in blocks."""
    same = F.expr("w = 1 OR get(near, left - 1) = before OR get(near, left + 1) = after") if beside else F.lit(True)
    parts = [index.join(F.broadcast(b), "term") for b in _blocks(places, terms_a_pass, ("term", "item_id", "item", "j"))]
    return _union(parts, index.join(places, "term")).filter(same).drop("before", "after")


def phrases(own: DataFrame, places: DataFrame, index: DataFrame, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """(doc_id, doc, item_id, start, end): exact stretches of at least a window, document places, end inclusive.

    Anchors on one diagonal of a document and item are gathered; one alone, of a window of several words, is no candidate.
    """
    lists = (
        _placed(places, index, terms_a_pass, True)
        .groupBy("doc_id", "doc", "item_id", "item", "w", (F.col("pos") - F.col("j")).alias("diagonal"))
        .agg(F.array_sort(F.collect_list(F.struct("j", "pos", "left", "near"))).alias("at"))
        .withColumn("at", F.expr("filter(at, (a, i) -> w = 1 OR (i > 0 AND a.j - at[i - 1].j < w) OR (i + 1 < size(at) AND at[i + 1].j - a.j < w))"))
        .filter("size(at) > 0")
    )
    texts = own.select("item", F.col("item_id").alias("_id"), "words")
    cands = lists.join(texts, (lists["item"] == texts["item"]) & lists["item_id"].eqNullSafe(F.col("_id"))).select("doc_id", "doc", "item_id", "w", "words", F.explode("at").alias("a"))
    same = lambda sign: f"""length(regexp_extract(array_join(transform(sequence(1, w - 1), d -> IF(
        a.j {sign} d >= 0 AND a.left {sign} d >= 0 AND coalesce(get(words, a.j {sign} d) = get(a.near, a.left {sign} d), false), '1', '0')), ''), '^1*', 0))"""  # noqa: E731
    runs = cands.withColumn("before", F.expr(f"IF(w = 1, 0, {same('-')})")).withColumn("after", F.expr(f"IF(w = 1, 0, {same('+')})"))
    return runs.filter("before + after + 1 >= w").select(
        "doc_id", "doc", "item_id", F.expr("a.pos - before").alias("start"), F.expr("a.pos + after").alias("end")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and doc, the key of the row's contents).

    Null and empty texts have no words and are clean, as are all if no item has words. Rows that share an id but not their text
    are judged apart; equal rows get equal results. Null ids are ids. Other columns of docs and items don't matter.
    """
    found = phrases(*build(docs, items, window, True, terms_a_pass), terms_a_pass)
    per_doc = found.groupBy("doc_id", "doc").agg(F.collect_set(F.struct("start", "end")).alias("runs"), F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids"))
    hits = per_doc.select(
        F.col("doc_id").alias("_id"),
        F.col("doc").alias("_doc"),
        F.size(F.array_distinct(F.flatten(F.expr("transform(runs, r -> sequence(r.start, r.end))")))).cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"),
    )
    rows = docs.select("doc_id", C.row_key("doc_id", "text").alias("doc"), F.size(words("text")).cast("long").alias("n_words"))
    none = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return rows.join(hits, (rows["doc"] == hits["_doc"]) & rows["doc_id"].eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        "n_words",
        none.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (none > 0).alias("contaminated"),
        "doc",
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, most_hit: float = 0.0) -> DataFrame:
    """The rows of docs of whose words no more than the share `most_hit` is hit, with all their columns."""
    judged = contamination(docs, items, window).filter(F.col("n_hit") > most_hit * F.col("n_words")).select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).distinct()
    keyed = docs.select(C.packed(docs), C.row_key("doc_id", "text").alias("_key"))
    return keyed.join(judged, (keyed["_key"] == judged["_doc"]) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*C.unpacked(docs))


def near(docs: DataFrame, items: DataFrame, window: int = 10, share: float = 0.8, terms_a_pass: int = TERMS_A_PASS // 4) -> DataFrame:
    """Proximity matches. Per row of docs: doc_id, n_near_items, near_items_sha256, near (and doc, the key of the row's contents).

    An item is near if some window of its words becomes a stretch of the document by at most window - share * window changes: words
    replaced, put in or left out. Exact phrases are near, too. No count of a word decides: a window of e changes at most, parted in e + 1,
    has a part without one, so all parts' words in a row are looked up, and the words either side of each found one are compared.
    Nulls, empty texts, repeated ids and rows are as in contamination(). Windows have up to 200 words; others are refused, as a word is one letter.
    """
    if not 1 <= window <= 200:
        raise ValueError("a window has 1 to 200 words")
    own = C.stored(_items(items, window).withColumn("e", F.expr(f"cast(floor((1 - {share}D) * w + 1e-9D) AS int)")).withColumn("g", F.expr("w div (e + 1)").cast("int")), "near-items")
    texts = docs.select("doc_id", C.row_key("doc_id", "text").alias("doc"), words("text").alias("_words"))
    parts = []
    for g in sorted(r.g for r in own.select("g").distinct().collect()):
        row = lambda c, at, g=g: F.xxhash64(*[F.expr(f"get({c}, {at} + {k})") for k in range(g)])
        grams = own.filter(F.col("g") == g).select("item_id", "w", "e", "words", F.explode(F.expr(f"sequence(0, size(words) - {g})")).alias("j"))
        grams = grams.select(
            "item_id", "w", "e", row("words", "j").alias("term"), F.expr(f"reverse(slice(words, greatest(j - w + {g}, 0) + 1, least(j, w - {g})))").alias("before"), F.expr(f"slice(words, j + {g + 1}, w - {g})").alias("after")
        )
        grams = C.stored(grams.distinct(), "near-grams")
        spots = texts.select("doc_id", "doc", "_words", F.explode_outer(F.expr(f"IF(size(_words) >= {g}, sequence(0, size(_words) - {g}), NULL)")).alias("pos"))
        spots = spots.select("doc_id", "doc", "_words", "pos", row("_words", "pos").alias("term"))
        for b in _blocks(grams, terms_a_pass, tuple(grams.columns)):
            parts.append(
                spots.join(F.broadcast(b), "term").select(
                    "doc_id", "doc", "item_id", "w", "e", F.lit(g).alias("g"), "before", "after",
                    F.expr(f"reverse(slice(_words, greatest(pos - w + {g} - e, 0) + 1, least(pos, w - {g} + e)))").alias("left"), F.expr(f"slice(_words, pos + {g + 1}, w - {g} + e)").alias("right"),
                )
            )
    # A word is the letter of its place among the item's, so that words are compared by the distance of strings.
    letters = lambda of, among: f"array_join(transform({of}, x -> char(33 + array_position({among}, x))), '')"
    # For each number of the item's words: the least changes to what begins there.
    costs = lambda a, b: f"""transform(sequence(0, length({a})), n -> IF(n - e > length({b}), e + 1,
        array_min(transform(sequence(greatest(n - e, 0), least(n + e, length({b}))), k -> levenshtein(left({a}, n), left({b}, k))))))"""  # noqa: E731
    if parts:
        cands = reduce(DataFrame.unionByName, parts)
        cands = cands.select("doc_id", "doc", "item_id", "w", "e", "g", *[F.expr(letters(of, among)).alias(name) for of, among, name in (("before", "before", "a"), ("left", "before", "b"), ("after", "after", "c"), ("right", "after", "d"))])
        cands = C.stored(cands, "near-candidates").withColumn("l", F.expr(costs("a", "b"))).withColumn("r", F.expr(costs("c", "d")))
        found = cands.filter(F.expr("exists(transform(l, (x, i) -> x + coalesce(get(r, w - g - i), e + 1)), x -> x <= e)"))
        found = found.select("doc_id", "doc", "item_id").distinct()
    else:
        found = texts.limit(0).select("doc_id", "doc", F.lit(None).cast("long").alias("item_id"))
    hits = found.groupBy("doc_id", "doc").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "ids")
    rows = docs.select("doc_id", C.row_key("doc_id", "text").alias("doc"))
    return rows.join(hits, (rows["doc"] == hits["_doc"]) & rows["doc_id"].eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_near_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("near_items_sha256"),
        F.col("ids").isNotNull().alias("near"),
        "doc",
    )
