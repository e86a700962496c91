"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts are canonicalised word by word: numbers, names and units become typed
placeholders that carry the value they stand for, everything else is
lower-cased.  Words have three forms: the template in which a capitalised word
behind a lower-case one is a name; the one in which every capitalised word is a name, sentence starts included;
and the plain words.

1. Each form of a text gives an array of word hashes, from which those of all its windows of WINDOW words
   come by doubling (1, 2, 4, 8 words).  Windows of all documents are hash-joined with those of the items.
2. Documents with a hit are read again; hits are compared word by word, so a hash decides nothing,
   and the values of their slots are taken.
3. Windows of one document and item at one distance form an alignment, for each template.  It counts when it covers
   half of the item's windows, or ENOUGH of them, and its slots are consistent: each value of the item stands against one
   value of the document, throughout.  Plain windows count by themselves, whatever slots conflict elsewhere.  The same
   holds for the distinct windows of the item over all distances, for words may be inserted or left out.

Items of less than WINDOW words, down to one word, are joined as one window of their own
length; templates are asked for from TEMPLATE_WORDS words on, the plain words at any length.
A window of a template needs one word that isn't a placeholder (for a window of placeholders alone would
match any values; a shorter window needs all but two); plain ones need none.  What the windows of an alignment cover must hold
MIN_LITERALS such words, or all that the item has where these are fewer, but three at least.

Null texts are empty and match nothing; a null doc_id or item_id is reported
as null.  Different texts under one doc_id are judged each by itself, and so are items
under one item_id.  Repeated rows count once.  Empty tables give an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, materialise

#: Words of a template window.
WINDOW = 8
#: Words of the shortest window that is looked for by templates.
TEMPLATE_WORDS = 4
#: Words of an item that aren't placeholders, of which its template windows must cover so many (or all, of three).
MIN_LITERALS, LEAST_LITERALS = 4, 3
#: Windows (13 words in a row) that are enough for any item.
ENOUGH = 6
#: Share of an item's windows that is enough.
SHARE = 0.5
#: Benchmark windows, or keys of documents, up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Units of measure that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl dl l gal s sec min h hr hrs hours minutes seconds days weeks months years "
    "km/h mph hz khz mhz ghz w kw mw v a j kj kcal cal pa kpa bar k c f °c °f % usd eur gbp dollars euros cents percent "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres"
).split()

#: Control characters around the type and value of a placeholder (Latin-1, which regular expressions read fastest).
_OPEN, _CLOSE = "\x01", "\x02"
#: Types of slots in the two templates; q is a capitalised word at any other place.
_TYPES = ("nup", "nupq")
#: What stands for a whole item.
_ITEM = ("windows1", "windows2", "item_windows", "literals1", "literals2")


def spaced(text: Column) -> Column:
    """A text with one space before each word."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), rf"[{_OPEN}{_CLOSE}\t-\r\x1c-\x1f\x85]\s*+| \s++", " ")


def canonical(text: Column) -> Column:
    """Template of a text, one word for each word; a placeholder holds its type and value.

    All expressions begin at the space before a word: those that begin with a look-behind are tried at every character.
    """
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    t = F.regexp_replace(spaced(text), rf"(\d )({units})(?=[ .,;:!?)]|$)", f"$1{_OPEN}u:$2{_CLOSE}")
    t = F.regexp_replace(t, rf" (?=\S*?\d)([^ {_OPEN}]++)", f" {_OPEN}n:$1{_CLOSE}")
    t = F.regexp_replace(t, rf" (?<=[\p{{Ll}},;{_CLOSE}] )(\p{{Lu}}\p{{Ll}}++)", f" {_OPEN}p:$1{_CLOSE}")
    t = F.regexp_replace(t, r" ([\"'(\[]*+)(\p{Lu}\p{Ll}++)", f" $1{_OPEN}q:$2{_CLOSE}")
    return F.lower(F.trim(t))


def forms(text: Column) -> list[Column]:
    """A canonical text without the values of its slots, in both templates, and in plain words."""
    slot = lambda t, types, by: F.regexp_replace(t, f"{_OPEN}[{types}]:([^{_CLOSE}]*+){_CLOSE}", by)
    typed = F.regexp_replace(text, f"{_OPEN}([nup]):[^{_CLOSE}]*+{_CLOSE}", "<$1>")
    return [slot(typed, "q", "$1"), slot(typed, "q", "<p>"), slot(text, "nupq", "$1")]


def _split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _slots(window: Column, types: str) -> Column:
    return F.regexp_extract_all(F.regexp_replace(window, f"{_OPEN}q:", f"{_OPEN}p:") if "q" in types else window, F.lit(f"{_OPEN}([nup]:[^{_CLOSE}]*){_CLOSE}"), F.lit(1))


def _seeded(form: int):
    return lambda word: F.xxhash64(word, F.lit(form))


def _join_at(a: str, b: str, shift: int) -> Column:
    """Hashes of what two arrays of hashes stand for, b's `shift` words behind a's; behind the last full window they mean nothing."""
    return F.transform(a, lambda x, i: F.xxhash64(x, F.get(F.col(b), i + F.lit(shift))))


def window_hashes(table: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """keys, n (words) and for each form k and length L an array h{L}_{k} of n hashes, of the window that begins at each word.

    The last L-1 of them, which aren't whole, stand for no window.
    One projection for each step, so that no array is worked out twice; those who explode them
    do it with the outer form, for Spark else filters by the size of an array it would build anew.
    """
    t = table.select(*keys, canonical(F.col("text")).alias("c"), F.lower(F.trim(spaced(F.col("text")))).alias("t2"))  # the plain words need no placeholder undone
    t = t.select(*keys, *(f.alias(f"t{k}") for k, f in enumerate(forms(F.col("c"))[:2])), "t2")
    t = t.select(*keys, *(_split(F.col(f"t{k}")).alias(f"w{k}") for k in range(3)))
    t = t.select(*keys, F.size("w2").alias("n"), *(F.transform(f"w{k}", _seeded(k)).alias(f"h1_{k}") for k in range(3)))
    have = [1]
    while 2 * have[-1] <= max(lengths):
        step = have[-1]
        t = t.select("*", *(_join_at(f"h{step}_{k}", f"h{step}_{k}", step).alias(f"h{2 * step}_{k}") for k in range(3)))
        have.append(2 * step)
    for length in (x for x in lengths if x not in have):  # a sum of powers of two
        done = 0
        for step in (x for x in reversed(have) if length & x):
            t = t.select("*", *((_join_at(f"h{done}_{k}", f"h{step}_{k}", done) if done else F.col(f"h{step}_{k}")).alias(f"h{done + step}_{k}") for k in range(3) if f"h{done + step}_{k}" not in t.columns))
            done += step
    return t.select(*keys, "n", *(f"h{x}_{k}" for x in lengths for k in range(3)))


def _asked(lengths: list[int]) -> list[tuple[int, int]]:
    """Lengths and forms that are looked for."""
    return [(x, k) for x in lengths for k in range(3) if k == 2 or x >= TEMPLATE_WORDS]


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """A row for each window and form that is looked for: item, item_id, length, ipos, form, h, win (canonical words), literals (places in the item of words that aren't placeholders).

    windows1, windows2, item_windows and literals1, literals2 count the item's windows and literals in each form.
    """
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    words = rows.select("item_id", "text", _split(canonical(F.col("text"))).alias("words"))
    sized = words.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window))).withColumn("item", F.monotonically_increasing_id())
    sized = materialise(sized, "benchmark-items")  # the numbers stay
    lengths = sorted(r[0] for r in sized.select("length").distinct().collect())  # `window` of them at most
    if not lengths:
        lengths = [window]
    hashed = window_hashes(sized, ["item", "item_id", "length", "words"], lengths)
    each = None
    for length, form in _asked(lengths):
        own = hashed.where(F.col("length") == length).select("item", "item_id", "length", F.lit(form).alias("form"), "words", "n", F.posexplode_outer(f"h{length}_{form}").alias("ipos", "h")).where((F.col("ipos") <= F.col("n") - length) & F.col("h").isNotNull())
        own = own.withColumn("win", F.array_join(F.slice("words", F.col("ipos") + 1, F.lit(length)), " ")).drop("words", "n")
        spots = F.filter(F.transform(F.split(forms(F.col("win"))[form], " "), lambda w, i: F.when(~w.startswith("<"), F.col("ipos") + i)), lambda x: x.isNotNull())
        own = own.withColumn("literals", F.array().cast("array<int>") if form == 2 else spots)
        own = own.withColumn("use", F.lit(True) if form == 2 else F.size("literals") >= (1 if length == window else min(MIN_LITERALS, length - 2)))
        each = own if each is None else each.unionAll(own)
    by_item = W.partitionBy("item")  # windows of one item
    of = lambda k: F.sum((F.col("use") & (F.col("form") == k)).cast("long")).over(by_item)
    all_of = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("form") == k, F.col("literals"))).over(by_item))))
    counted = each.withColumns({"windows1": of(0), "windows2": of(1), "item_windows": of(2), "literals1": all_of(0), "literals2": all_of(1)})
    return materialise(counted.where("use").drop("use"), "benchmark-windows")


def _small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), item, ipos, form, length, pos: windows of one hash."""
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [WINDOW]
    asked = _asked(lengths)
    hashed = window_hashes(docs, ["doc_id", "digest"], lengths)
    flat = hashed.select("doc_id", "digest", "n", F.posexplode_outer(F.concat(*(F.col(f"h{x}_{k}") for x, k in asked))).alias("at", "h"))
    met = flat.join(_small(items.select("item", "ipos", "form", "length", "h")), "h")
    arrays = F.lit(0)  # before that of the item's length and form
    for number, (x, k) in enumerate(asked):
        arrays = F.when((F.col("length") == x) & (F.col("form") == k), F.lit(number)).otherwise(arrays)
    met = met.withColumn("pos", F.col("at") - arrays * F.col("n"))
    return met.where("pos between 0 and n - length").select("doc_id", "digest", "item", "ipos", "form", "length", "pos")


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])


def _compared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, digest, item, item_id, shift, ipos, form, pairs (slots of item and document), literals of windows that are the same in a form."""
    hits = materialise(_hits(docs, items), "benchmark-hits")
    keys = _small(materialise(hits.select("doc_id", "digest").distinct(), "benchmark-hit-docs"))
    some = docs.join(keys, _same_doc(docs, keys), "left_semi").distinct().select("doc_id", "digest", _split(canonical(F.col("text"))).alias("words"))
    # The hits of one text: no more than its windows times the items that share one.
    by_doc = hits.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("item", "ipos", "form", "length", "pos")).alias("hits"))
    each = some.join(by_doc, _same_doc(some, by_doc)).select(some["doc_id"], some["digest"], F.explode(F.transform("hits", lambda x: F.struct(x.alias("hit"), F.array_join(F.slice(F.col("words"), x["pos"] + 1, x["length"]), " ").alias("win")))).alias("x"))
    each = each.select("doc_id", "digest", "x.hit.*", F.col("x.win").alias("dwin"))
    met = each.join(_small(items.select("item", "item_id", "ipos", "form", "win", "literals", *_ITEM)), ["item", "ipos", "form"])
    same, pairs = F.lit(False), F.lit(None)
    for k, (a, b) in enumerate(zip(forms(F.col("win")), forms(F.col("dwin")), strict=True)):
        same = F.when(F.col("form") == k, a == b).otherwise(same)
    for k, types in enumerate(_TYPES):
        zipped = F.arrays_zip(_slots(F.col("win"), types).alias("islots"), _slots(F.col("dwin"), types).alias("slots"))
        pairs = F.when(F.col("form") == k, zipped).otherwise(pairs)
    return met.where(same).select("doc_id", "digest", "item", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", "form", pairs.alias("pairs"), "literals", *_ITEM)


def _found(hits: DataFrame, by: list[str]) -> DataFrame:
    """n1, n2, n3: distinct windows of the item by each form; slots and conflicts of the templates."""
    # Values of one alignment: a few words, for there are no more windows in it than in the item.
    pairs = [F.array_distinct(F.flatten(F.collect_set(F.when(F.col("form") == k - 1, F.col("pairs"))))).alias(f"pairs{k}") for k in (1, 2)]
    n = [F.size(F.collect_set(F.when(F.col("form") == k - 1, F.col("ipos")))).alias(f"n{k}") for k in (1, 2, 3)]
    covered = [F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("form") == k - 1, F.col("literals")))))).alias(f"covered{k}") for k in (1, 2)]
    out = hits.groupBy(*by).agg(*n, *covered, *(F.max(c).alias(c) for c in _ITEM), *pairs)
    for k in (1, 2):
        sources = F.size(F.array_distinct(F.transform(f"pairs{k}", lambda p: p["islots"])))
        out = out.withColumn(f"slots{k}", sources).withColumn(f"conflicts{k}", F.size(f"pairs{k}") - F.col(f"slots{k}"))
    return out.drop("pairs1", "pairs2")


def _digested(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))


def _contaminated(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, digest, item_id, n_windows, item_windows, n_slots of each text and item that it holds."""
    hits = materialise(_compared(_digested(docs), item_windows(benchmark, window)), "benchmark-same")  # two groupings read them
    enough = lambda n, of: (F.col(n) > 0) & ((F.col(n) >= ENOUGH) | (F.col(n) >= SHARE * F.col(of)))
    # Words that aren't placeholders; an item shorter than a window has its own rule for them.
    told = lambda k: (F.col("item_windows") == 1) | ((F.col(f"covered{k}") >= F.least(F.lit(MIN_LITERALS), f"literals{k}")) & (F.col(f"literals{k}") >= LEAST_LITERALS))
    ways = [enough("n1", "windows1") & (F.col("conflicts1") == 0) & told(1), enough("n2", "windows2") & (F.col("conflicts2") == 0) & told(2), enough("n3", "item_windows")]
    columns = ["doc_id", "digest", "item", "item_id", "n_windows", "item_windows", "n_slots"]
    parts = []
    for by in (["doc_id", "digest", "item", "item_id", "shift"], ["doc_id", "digest", "item", "item_id"]):
        found = _found(hits, by)
        found = found.withColumn("n_windows", F.greatest(*(F.when(w, F.col(f"n{k}")) for k, w in enumerate(ways, 1))))
        parts.append(found.withColumn("n_slots", F.coalesce(F.greatest(*(F.when(w, F.col(f"slots{k}")) for k, w in enumerate(ways[:2], 1))), F.lit(0))).where("n_windows is not null").select(columns))
    return parts[0].unionAll(parts[1])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document and benchmark item it holds: doc_id, item_id, n_windows, item_windows, n_slots, coverage."""
    best = _contaminated(docs, benchmark, window).groupBy("doc_id", "item_id")
    out = best.agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").alias("n_slots"))
    return out.withColumn("coverage", F.col("n_windows") / F.col("item_windows"))


def decontaminate_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    doc, digest = fresh("_doc", docs), fresh("_digest", docs)
    held = _contaminated(docs, benchmark, window).select(F.col("doc_id").alias(doc), F.col("digest").alias(digest)).distinct()
    held = _small(materialise(held, "benchmark-held"))
    return docs.join(held, docs["doc_id"].eqNullSafe(held[doc]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == held[digest]), "left_anti")
