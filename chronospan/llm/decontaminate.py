"""Benchmark decontamination by template canonicalisation (operator 1), with DataFrame functions only.

Numbers, quantities with a unit, and names become typed placeholders; what is
left is lower-cased and freed of punctuation. A text has three forms with the
same positions: ``FIRM`` takes capitalised words right after a lower-case one
for names, ``LOOSE`` every capitalised word (names also start sentences and
follow brackets, quotes and numbers), and the exact form has no placeholder.
Tokens are parted by white space of any kind; in scripts without blanks each
character is one. Windows of ``WINDOW`` tokens of each form of all documents are hash-joined with
those of the benchmark items. Windows with more placeholders than
``MOST_SLOTS`` are hashed in the exact form alone, and an item of fewer than
``WINDOW`` tokens is one exact window of its own length.

Matches on one diagonal (same document, item and distance) are a candidate. Its
tokens are then compared in full, for both forms, so windows that were too full
of placeholders to be hashed count as well. It is a finding if it covers enough
of the item and its slots are consistent: each value of the item stands for
one value of the document. (Two values may become the same one.) Equal slots
make a ``verbatim`` copy, others a ``reparameterised`` one.

The units are ``UNITS``. The benchmark's windows are sent to every executor
while they are small, else joined by shuffle.

Defined results: documents of a null id are documents like others, and texts of one id are looked at each for itself: a
finding is of the id, but only the texts that hold an item go. Null text and items without a token match nothing; items of
fewer than ``WINDOW`` tokens match exactly only, however short; items whose
windows all have more than ``MOST_SLOTS`` placeholders match exactly only;
equal rows are one document or item; empty tables give no rows; other columns
are ignored, whatever their names; the private-use characters U+E000 to U+E004
in a text are taken for signs of placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, maybe_broadcast, null_safe, spread

WINDOW = 8
MOST_SLOTS = 4
#: A finding counts from this share of the item's windows on, or from so many windows on.
SHARE, ENOUGH = 0.5, 8
UNITS = (
    "kg|mg|g|lbs?|oz|tons?|km|cm|mm|m|miles?|feet|ft|inch(?:es)?|yards?|l|ml|lit(?:er|re)s?|gallons?|ms|s|min|h|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|%|°C|°F|mph|kmh|USD|EUR"
)
_NUMBER, _QUANTITY, _NAME, _CAPITAL = "\ue001", "\ue002", "\ue003", "\ue004"
#: Ends the digits of a number until its unit, if any, is known.
_UNIT = "\ue000"
#: Forms of a text by what they take for a name, and what their placeholder tokens begin with.
FIRM, LOOSE = "firm", "loose"
_SLOT = {FIRM: f"^[{_NUMBER}-{_NAME}]", LOOSE: f"^[{_NUMBER}-{_CAPITAL}]"}
_SIGNS = f"[{_NUMBER}-{_CAPITAL}]"
#: A look ahead comes first, as it is what most places fail.
_DIGITS = rf"(?=[$€£\d])(?<![\p{{L}}\p{{N}}{_NUMBER}{_QUANTITY}])[$€£]?(\d[\d.,:/]*)"
#: White space beyond ASCII, and signs of no width.
_BLANKS = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Characters of scripts without blanks: Thai to Tibetan, Burmese, Khmer, and Han, Kana and their signs.
_UNSPACED = "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff]"
_WHITE = "\t\n\v\f\r"
_PUNCTUATION = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡" + _UNIT


def parted(text: Column) -> Column:
    """A text whose white space is blanks, with blanks round each character of a script without them."""
    odd = text.rlike("[\u0085\u00a0\u00ad\u0e00-\uffff]")  # all that the next line could change, and a little more
    plain = F.regexp_replace(F.translate(text, _BLANKS + _NO_WIDTH, " " * len(_BLANKS)), f"({_UNSPACED})", " $1 ")
    return F.when(odd, plain).otherwise(text)


def signed(text: Column) -> Column:
    """A text whose placeholders are their sign and what they stand for, lower-cased and freed of punctuation; its white space is blanks."""
    found = F.regexp_replace(text, rf"{_DIGITS}(?:\s?((?i:{UNITS}))(?![\p{{L}}\p{{N}}]))?", f" {_NUMBER}$1{_UNIT}$2 ")
    numbers = F.regexp_replace(found, rf"{_NUMBER}(\d[\d.,:/]*){_UNIT}(?! )", f"{_QUANTITY}$1_")
    digits = F.when(text.rlike(r"\d"), numbers).otherwise(text)
    names = F.regexp_replace(digits, r"(?=\p{Lu})(?<=\p{Ll} |\p{Ll}, )(\p{Lu}[\p{L}\p{M}]*)", f"{_NAME}$1")
    capitals = F.regexp_replace(names, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}{_NAME}])(\p{{Lu}}[\p{{L}}\p{{M}}]*)", f"{_CAPITAL}$1")
    return F.lower(F.translate(capitals, _WHITE + _PUNCTUATION, " " * len(_WHITE)))


def canonical(text: Column) -> Column:
    """Tokens of a text; a placeholder's token is its sign and what it stands for."""
    return _tokens(signed(parted(text)))


def _tokens(signed: Column) -> Column:
    """Tokens of a signed text, which are parted by blanks alone."""
    return F.array_remove(F.split(F.coalesce(signed, F.lit("")), " "), "")


def bare(token: Column) -> Column:
    return F.translate(token, _NUMBER + _QUANTITY + _NAME + _CAPITAL, "")


def templated(token: Column, form: str = FIRM) -> Column:
    """The token; a placeholder is cut to its sign, which is one for all names."""
    sign = F.translate(F.substring(token, 1, 1), _CAPITAL, _NAME)
    return F.when(~token.rlike(_SIGNS), token).when(token.rlike(_SLOT[form]), sign).otherwise(bare(token))


def template(tokens: Column, form: str = FIRM) -> Column:
    """The tokens with placeholders cut to their signs; positions are those of ``tokens``."""
    return F.transform(tokens, lambda t: templated(t, form))


def hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, sign, x, f, l), one a text: each token's first code point and its hash in the exact, firm and loose form.

    Tokens without signs are split from the text once more, as many and in the
    same places; so only plain hashes and numbers are handled token by token.
    """
    whole = rows.where("text is not null").select(*keys, parted(F.col("text")).alias("text"))
    texts = whole.select(*keys, signed(F.col("text")).alias("signed"))
    tokens = texts.select(
        *keys, F.transform(_tokens(F.col("signed")), lambda t: F.ascii(t)).alias("sign"), F.transform(_tokens(bare(F.col("signed"))), lambda t: F.xxhash64(t)).alias("x")
    )
    number, name, capital = ord(_NUMBER), ord(_NAME), ord(_CAPITAL)
    firm = F.zip_with("sign", "x", lambda s, h: F.when(s.between(number, name), s.cast("long")).otherwise(h))
    loose = F.zip_with("sign", "x", lambda s, h: F.when(s.between(number, capital), F.least(s, F.lit(name)).cast("long")).otherwise(h))
    return tokens.select(*keys, "sign", "x", firm.alias("f"), loose.alias("l"))


def window(form: str, k: int = WINDOW) -> Column:
    """Hash of the ``k`` tokens from position ``pos`` on; null where the text ends before."""
    return F.when(F.col(form).isNotNull() & (F.col("pos") <= F.size(form) - k), F.xxhash64(*[F.get(F.col(form), F.col("pos") + j) for j in range(k)]))


def item_windows(items: DataFrame) -> DataFrame:
    """Rows (item_id, item_pos, item_windows, coded, k, h) of the windows, of ``k`` tokens, that can identify an item.

    ``coded`` of the ``item_windows`` windows have a template among their hashes.
    """
    tokens = hashed(items, ["item_id"]).distinct()
    slots = lambda last: lambda i: F.size(F.filter(F.slice("sign", i + 1, F.lit(WINDOW)), lambda s: s.between(ord(_NUMBER), ord(last))))
    few = {"f": lambda i: slots(_NAME)(i) <= MOST_SLOTS, "l": lambda i: slots(_CAPITAL)(i) <= MOST_SLOTS}
    at = F.sequence(F.lit(0), F.size("x") - WINDOW)
    full = tokens.where(F.size("x") >= WINDOW).withColumn("coded", F.size(F.filter(at, lambda i: few["f"](i) | few["l"](i))))
    placed = full.select("*", F.explode(at).alias("pos"))
    kept = F.array_distinct(F.array_compact(F.array(window("x"), *[F.when(few[form](F.col("pos")), window(form)) for form in few])))
    long = placed.select("item_id", F.col("pos").alias("item_pos"), (F.size("x") - (WINDOW - 1)).alias("item_windows"), "coded", F.lit(WINDOW).alias("k"), F.explode(kept).alias("h"))
    whole = F.coalesce(*[F.when(F.size("x") == k, window("x", k)) for k in range(1, WINDOW)])
    short = tokens.where((F.size("x") > 0) & (F.size("x") < WINDOW)).withColumn("pos", F.lit(0)).select(
        "item_id", F.col("pos").alias("item_pos"), F.lit(1).alias("item_windows"), F.lit(1).alias("coded"), F.size("x").alias("k"), whole.alias("h")
    )
    return long.unionByName(short)


def doc_windows(docs: DataFrame, short: list[int]) -> DataFrame:
    """Rows (doc_id, copy, pos, h) of the windows of all forms, and of exact windows of the lengths ``short``."""
    texts = hashed(docs.select("doc_id", "copy", "text"), ["doc_id", "copy"])
    least = min([WINDOW, *short])
    # A form that a whole text has no sign of is left out, not hashed at each place.
    texts = texts.withColumn("l", F.when((F.col("l") != F.col("f")) & (F.col("l") != F.col("x")), F.col("l"))).withColumn("f", F.when(F.col("f") != F.col("x"), F.col("f")))
    placed = texts.where(F.size("x") >= least).select("doc_id", "copy", "x", "f", "l", F.explode(F.sequence(F.lit(0), F.size("x") - least)).alias("pos"))
    w = placed.select("doc_id", "copy", "pos", *[window(form).alias(form) for form in "xfl"], *[window("x", k).alias(f"x{k}") for k in short])
    firm, loose = F.when(F.col("f") != F.col("x"), F.col("f")), F.when(~F.col("l").eqNullSafe(F.col("f")) & (F.col("l") != F.col("x")), F.col("l"))
    return w.select("doc_id", "copy", "pos", F.explode(F.array("x", firm, loose, *[f"x{k}" for k in short])).alias("h")).where("h is not null")


#: What tells a document's text: its id and the hash of its text, as an id may be null or stand for several texts.
COPY = ["doc_id", "copy"]


def copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, copy, text) of the documents with a text."""
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")


def matches(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, copy, item_id, shift, item_windows): diagonals of ``copies`` that may cover enough of an item."""
    known = Stored(item_windows(items), "item_windows")
    short = sorted(r.k for r in known.df.where(F.col("k") < WINDOW).select("k").distinct().collect())
    met = doc_windows(texts, short).join(maybe_broadcast(known), "h")
    diagonal = met.groupBy(*COPY, "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.max("item_windows").alias("item_windows"), F.max("coded").alias("coded"), F.countDistinct("item_pos").alias("n")
    )
    return diagonal.where((F.col("n") >= ENOUGH) | (F.col("n") >= SHARE * F.col("coded"))).drop("coded", "n")


def leaky(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, copy, item_id, best) of the texts in which an item is found."""
    texts = copies(spread(docs))
    found = Stored(matches(texts, items), "leak_matches")
    hit = null_safe(texts, maybe_broadcast(Stored(found.df.select(*COPY).distinct(), "leak_docs")), COPY, "left_semi")
    doc_tokens = hit.dropDuplicates(COPY).select(*COPY, canonical(F.col("text")).alias("dt"))
    item_tokens = items.where("text is not null").select("item_id", canonical(F.col("text")).alias("it")).distinct()
    both = null_safe(found.df, doc_tokens, COPY).join(maybe_broadcast(Stored(item_tokens, "item_tokens")), "item_id")
    spot = F.transform("it", lambda t, i: F.struct(t.alias("i"), F.when(i + F.col("shift") >= 0, F.get("dt", i + F.col("shift"))).alias("d")))
    # An item of fewer tokens than a window identifies itself by all its values alone.
    short = F.size("it") < WINDOW
    pieces = both.select(*COPY, "item_id", "item_windows", F.least(F.size("it"), F.lit(WINDOW)).alias("k"), short.alias("short"), spot.alias("spot"))
    # Read for either form; texts are canonicalised, and tokens compared, once.
    aligned = Stored(pieces.select("*", *[_starts(form).alias(form) for form in (FIRM, LOOSE)]), "leak_pieces").df
    forms = [_judged(aligned, form, rank) for rank, form in ((1, FIRM), (0, LOOSE))]
    checked = forms[0].unionByName(forms[1])
    enough = checked.where((F.col("n_windows") >= ENOUGH) | (F.col("n_windows") >= SHARE * F.col("item_windows")))
    ways = F.size(F.array_distinct(F.transform("pairs", lambda s: s["i"])))
    best = F.max(F.struct("n_windows", "same", "rank", "n_slots", "item_windows")).alias("best")
    return enough.where(ways == F.size("pairs")).groupBy(*COPY, "item_id").agg(best)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, item_windows, n_slots, kind), one a document id and item found in it."""
    return leaky(docs, items).groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select(
        "doc_id", "item_id", "best.n_windows", "best.item_windows", "best.n_slots", F.when(F.col("best.same"), "verbatim").otherwise("reparameterised").alias("kind")
    )


def _starts(form: str) -> Column:
    """Places of aligned tokens (i, d) from which ``k`` are alike in one form.

    What is alike is bound, and the places are stored: a filter on them would work it all out again for each window.
    """
    same = lambda s: F.coalesce(bare(s["i"]) == bare(s["d"]), F.lit(False))
    alike = lambda s: same(s) | (~F.col("short") & F.coalesce(templated(s["i"], form) == templated(s["d"], form), F.lit(False)))
    starts = lambda ok: F.filter(F.sequence(F.lit(0), F.size(ok) - F.col("k")), lambda i: F.forall(F.slice(ok, i + 1, F.col("k")), lambda x: x))
    return F.transform(F.array(F.transform("spot", alike)), starts)[0]


def _judged(aligned: DataFrame, form: str, rank: int) -> DataFrame:
    """Windows, slots and pairs of values of aligned tokens (i, d) in one form."""
    ranged = aligned.withColumn("starts", F.col(form)).where(F.size("starts") > 0)
    first, last = F.array_min("starts"), F.array_max("starts") + F.col("k")
    spots = F.slice("spot", first + 1, last - first)
    slots = F.filter(spots, lambda s: s["i"].rlike(_SLOT[form]) & F.coalesce(templated(s["i"], form) == templated(s["d"], form), F.lit(False)))
    values = F.transform(slots, lambda s: F.struct(bare(s["i"]).alias("i"), bare(s["d"]).alias("d")))
    held = ranged.select(*COPY, "item_id", "item_windows", F.size("starts").alias("n_windows"), F.size(slots).alias("n_slots"), F.array_distinct(values).alias("pairs"))
    return held.withColumn("same", F.forall("pairs", lambda s: s["i"] == s["d"])).withColumn("rank", F.lit(rank))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    lost = maybe_broadcast(Stored(leaky(docs, items).select(*COPY).distinct(), "leaky_docs"))
    other = lost.select(F.col("doc_id").alias("_lost"), F.col("copy").alias("_copy"))
    return docs.join(other, F.col("doc_id").cast("long").eqNullSafe(F.col("_lost")) & F.xxhash64("text").eqNullSafe(F.col("_copy")), "left_anti")
