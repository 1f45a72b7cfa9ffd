"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: names (runs of capitalised words), numbers and units
after a number give way to typed placeholders, the rest is lower-cased and cut
into words. Windows of WINDOW template words are hashed and joined with those of
the benchmark items, so a question with other numbers or names is found too. For
the documents found, the slots' values are compared along each alignment
(document position minus item position): one value of the item must always stand
for one value of the document, else the alignment doesn't count. A document is
contaminated by an item if the windows of its consistent alignments cover at
least COVERAGE of the item's words.

A word at a sentence's start is a slot like any name: its value takes part in the
comparison, so no list of words that are no names is needed. Windows of
placeholders only stand in any table of numbers and don't count; an item's
coverage is of the words in its other windows.

Which documents an item may have contaminated is decided by its rarer windows: all
windows but the commonest, of which together less than COVERAGE of the words is
covered. A document without any of the rarer ones can't reach it, so windows that
every document has pair nothing.

Defined cases: null or empty texts and items match nothing; a text of fewer than
WINDOW words is one window by itself, so short items match only whole texts;
an item of placeholders only matches nothing; repeated rows of one doc_id and
text are one; rows of one doc_id and different texts are looked at apart; a null
doc_id is an id like others, a null item_id isn't counted; an empty benchmark finds nothing; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgauge.llm.common import written

WINDOW, COVERAGE = 5, 0.75
#: Benchmark windows up to this number (8 bytes each and a little more) are broadcast; a larger benchmark is shuffled.
BROADCAST_WINDOWS = 1_000_000

# The placeholders and the mark after a value (private-use characters, which no word holds), and the units (in any case).
NUMBER, NAME, UNIT, END = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = "km cm mm m kg g mg lb lbs oz l ml s ms min h hr hours minutes seconds days weeks months years miles feet inches meters metres dollars euros cents percent degrees % € $ °"

NAME_PATTERN = r"\p{Lu}\p{Ll}+(?:[ \t-\r]+\p{Lu}\p{Ll}+)*"
NUMBER_PATTERN = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
#: The same runs for Java: a possessive group is matched in a loop, a greedy one by recursion, of which a run of some hundred words overflows the stack and ends the executor.
NAME_RUN, NUMBER_RUN = NAME_PATTERN + "+", NUMBER_PATTERN + "+"
UNIT_WORDS = "((?i:" + "|".join(u.replace("$", r"\$") for u in sorted(UNITS.split(), key=lambda u: (-len(u), u))) + r"))([^\p{L}\p{N}]|$)"
#: What stands between words.
GAP = f"[^\\p{{L}}\\p{{N}}{NUMBER}-{UNIT}]+"


def plain(text: Column) -> Column:
    """Text (null: empty) in which no placeholder stands."""
    return F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT + END, "    ")


def template(text: Column) -> Column:
    t = F.regexp_replace(plain(text), NAME_RUN, f" {NAME} ")
    t = F.regexp_replace(t, NUMBER_RUN, f" {NUMBER} ")
    t = F.regexp_replace(t, f"{NUMBER} {{1,2}}{UNIT_WORDS}", f"{NUMBER} {UNIT} $2")
    return F.lower(t)


def words(text: Column) -> Column:
    return F.filter(F.split(template(text), GAP), lambda w: w != "")


def slots(text: Column) -> Column:
    """The values behind the placeholders, in order: each stands after its placeholder for a moment."""
    t = F.regexp_replace(plain(text), NAME_RUN, f" {NAME}$0{END} ")
    t = F.regexp_replace(t, NUMBER_RUN, f" {NUMBER}$0{END} ")
    t = F.regexp_replace(t, f"({NUMBER}[^{END}]*{END}) {{1,2}}{UNIT_WORDS}", f"$1 {UNIT}$2{END} $3")
    return F.transform(F.regexp_extract_all(t, F.lit(f"[{NUMBER}-{UNIT}]([^{END}]*){END}"), F.lit(1)), lambda s: F.lower(F.regexp_replace(s, r"[ \t-\r]+", " ")))


def window_hashes(w: str) -> Column:
    """xxhash64 of every window of the array column `w`; fewer than WINDOW words: of the whole."""
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(n == 0, F.expr("cast(array() as array<bigint>)")).when(n < WINDOW, F.array(F.xxhash64(w, F.lit("whole")))).otherwise(long)


def is_slot(w: Column) -> Column:
    return w.isin(NUMBER, NAME, UNIT)


def slots_before(w: str, position: Column) -> Column:
    return F.size(F.filter(F.slice(w, F.lit(1), position), is_slot))


def covered(first: Column, n_words: Column) -> Column:
    """The word positions of the window that starts at `first`."""
    return F.sequence(first, F.least(first + (WINDOW - 1), n_words - 1))


def prepared(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, iw, is) and their windows (item, ip, hash, n_words: words in windows that count, iwords: all)."""
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct().withColumn("iw", words(F.col("item_text"))).where(F.size("iw") > 0)
    items = items.select(F.xxhash64("item_id", "item_text").alias("item"), "item_id", "iw", slots(F.col("item_text")).alias("is"))
    windows = items.select("item", "iw", F.size("iw").alias("iwords"), F.posexplode(window_hashes("iw")).alias("ip", "hash"))
    windows = windows.where(F.exists(F.slice("iw", F.col("ip") + 1, WINDOW), lambda x: ~is_slot(x))).drop("iw")
    size = windows.groupBy("item").agg(F.size(F.array_distinct(F.flatten(F.collect_list(covered(F.col("ip"), F.col("iwords")))))).alias("n_words"))
    return items, written(windows.join(size, "item"))


def rarer(windows: DataFrame, found: DataFrame) -> DataFrame:
    """(item, hash): the windows of which a contaminated document must have one."""
    common = found.groupBy("hash").agg(F.count("*").alias("df"))
    ranked = windows.join(common, "hash").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("df"), "hash", "ip")))
    # A word is covered from the rank on of the commonest window over it; the rank at which COVERAGE is reached is needed.
    words_ = ranked.select("item", "n_words", "rank", F.explode(covered(F.col("ip"), F.col("iwords"))).alias("p")).groupBy("item", "n_words", "p").agg(F.min("rank").alias("rank"))
    need = words_.groupBy("item", "n_words").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).select("item", F.get("ranks", F.ceil(COVERAGE * F.col("n_words")).cast("int") - 1).alias("need"))
    return ranked.join(need, "item").where("rank >= need").select("item", "hash").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, key (the text's hash), item_id, coverage, n_words, exact (alignments whose slots are all equal cover enough)."""
    items, windows = prepared(benchmark)
    known = windows.select("hash").distinct()
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    # First pass over all documents: only the places of known windows go on.
    d = docs.select("doc_id", "text").withColumn("w", words(F.col("text")))
    found = written(d.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(window_hashes("w")).alias("dp", "hash")).join(known, "hash").distinct())
    sets = found.select("doc_id", "key", "hash").distinct()
    # Pairs that can reach the coverage, whatever their slots say.
    pairs = sets.join(rarer(windows, sets), "hash").select("doc_id", "key", "item").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    met = sets.join(pairs.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).drop("d", "k").join(windows, ["item", "hash"])
    places = F.array_distinct(F.flatten(F.collect_list(covered(F.col("ip"), F.col("iwords")))))
    enough = written(met.groupBy("doc_id", "key", "item", "n_words").agg(places.alias("p")).where(F.size("p") >= COVERAGE * F.col("n_words")).drop("p"))
    # Second pass over the documents found: words and slot values again, window by window.
    some = enough.select("doc_id", "key").distinct()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    full = keyed.join(some.hint("merge"), same(keyed, some), "left_semi").dropDuplicates(["doc_id", "key"])
    full = written(full.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), words(F.col("text")).alias("w"), slots(F.col("text")).alias("ds")))
    hits = found.join(enough.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).drop("d", "k").join(windows.drop("n_words"), ["item", "hash"])
    at = hits.join(full, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).join(items, "item")
    n = F.size(F.filter(F.slice("iw", F.col("ip") + 1, WINDOW), is_slot))
    at = at.select("doc_id", "key", "item", "item_id", "n_words", "iwords", "ip", (F.col("dp") - F.col("ip")).alias("diagonal"), F.slice("is", slots_before("iw", F.col("ip")) + 1, n).alias("iv"), F.slice("ds", slots_before("w", F.col("dp")) + 1, n).alias("dv"))
    by = ["doc_id", "key", "item", "item_id", "n_words"]
    lines = at.groupBy(*by, "diagonal").agg(F.array_distinct(F.flatten(F.collect_set(covered(F.col("ip"), F.col("iwords"))))).alias("places"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("iv", "dv")))).alias("pairs"))
    lines = lines.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["iv"]))))
    equal = F.forall("pairs", lambda p: p["iv"] == p["dv"])
    all_of = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    both = lines.groupBy(*by).agg(all_of("places").alias("n"), all_of(F.when(equal, F.col("places"))).alias("same"))
    enough_of = lambda n: n >= COVERAGE * F.col("n_words")
    return both.where(enough_of(F.col("n"))).select("doc_id", "key", "item_id", F.round(F.col("n") / F.col("n_words"), 6).alias("coverage"), "n_words", enough_of(F.col("same")).alias("exact"))


def by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated document: doc_id, n_items, coverage (the most), exact (any), item_ids."""
    return contaminated(docs, benchmark).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("coverage").alias("coverage"), F.max("exact").alias("exact"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")
