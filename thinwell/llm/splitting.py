"""Problem 6: cutting oversized items at natural boundaries, in SQL expressions only.

A text over the limit is cut by one regular expression whose alternatives stand
in the order of boundary strength (end of text, paragraph, sentence, line,
clause, blank, and at last any character). Every alternative is a bounded
quantifier, so it takes at most limit - overlap characters. Each piece but the
first is led by up to `overlap` characters of the piece before, from a blank
where there is one. An image list over its limit becomes slices that share
`shared` images.

Characters are code points. Null texts and lists are no items; items within the
limit are not returned; null elements of an image list count as images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, OVERLAP = 1_200, 100
IMAGE_LIMIT, SHARED = 8, 1


def cut_pattern(most: int) -> str:
    """Alternatives by boundary strength, each of at most `most` characters; all but the last
    three want half of that, so that a strong boundary does not make a tiny piece."""
    half = max(1, most // 2)
    return "(?s)" + "|".join((
        rf".{{1,{most}}}\z",
        rf".{{{half},{most}}}(?<=\n[ \t]{{0,4}}\n)",
        rf".{{{half},{most}}}(?<=[.!?…。！？][\"'”’»)]{{0,2}}\s)",
        rf".{{{half},{most}}}(?<=\n)",
        rf".{{{half},{most}}}(?<=[;:,]\s)",
        rf".{{1,{most}}}(?<=\s)",
        rf".{{1,{most}}}(?![\p{{M}}\x{{200d}}\x{{fe0f}}])(?<!\x{{200d}})",
        rf".{{1,{most}}}",
    ))


def text_pieces(text: Column, limit: int = TEXT_LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the pieces of `text` (none of an empty one), each struct<shared int, piece string>: its first `shared`
    characters repeat the end of the piece before."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    cores = F.regexp_extract_all(text, F.lit(cut_pattern(limit - overlap)), F.lit(0))
    if not overlap:
        return F.transform(cores, lambda c: F.struct(F.lit(0).alias("shared"), c.alias("piece")))
    tail = lambda c: F.right(c, F.lit(overlap))
    # From the first word that begins inside the tail; the whole tail where none does.
    lead = lambda c: F.coalesce(F.nullif(F.regexp_extract(tail(c), r"(?s)\s(\S.*)\z", 1), F.lit("")), tail(c))
    leads = F.concat(F.array(F.lit("")), F.transform(F.slice(cores, F.lit(1), F.greatest(F.size(cores) - 1, F.lit(0))), lead))
    made = F.zip_with(leads, cores, lambda a, c: F.struct(F.length(a).alias("shared"), F.concat(a, c).alias("piece")))
    return F.filter(made, lambda p: p["piece"].isNotNull())


def list_pieces(items: Column, limit: int = IMAGE_LIMIT, shared: int = SHARED) -> Column:
    """Array of slices of at most `limit` elements, consecutive ones sharing `shared`."""
    if not 0 <= shared < limit:
        raise ValueError("the shared part must be less than the limit")
    step = limit - shared
    last = F.greatest(F.ceil((F.size(items) - limit) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * step + 1, F.lit(limit)))


def split_oversized(docs: DataFrame, limit: int = TEXT_LIMIT, overlap: int = OVERLAP, image_limit: int = IMAGE_LIMIT, shared: int = SHARED) -> DataFrame:
    """row_id, turn_idx, field, piece_idx, shared, piece, images: the pieces of every oversized item.

    Texts have turn_idx, field user or assistant, and `piece`; image lists have
    turn_idx -1, field images, and `images`. A row delivered twice counts once.
    """
    over = lambda f: F.exists("texts", lambda t: F.length(t[f]) > limit)
    wanted = over("user") | over("assistant")
    turns = docs.where(wanted).select("row_id", F.posexplode("texts").alias("turn_idx", "turn"))
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("turn")[f].alias("text")) for f in ("user", "assistant"))))
    texts = turns.select("row_id", "turn_idx", fields.alias("x")).select("row_id", "turn_idx", "x.*").where(F.length("text") > limit)
    texts = texts.select("row_id", "turn_idx", "field", F.posexplode(text_pieces(F.col("text"), limit, overlap)).alias("piece_idx", "x"))
    texts = texts.select("row_id", "turn_idx", "field", "piece_idx", "x.shared", "x.piece", F.lit(None).cast(docs.schema["images"].dataType).alias("images"))
    lists = docs.where(F.size("images") > image_limit).select("row_id", F.posexplode(list_pieces(F.col("images"), image_limit, shared)).alias("piece_idx", "images"))
    lists = lists.select("row_id", F.lit(-1).alias("turn_idx"), F.lit("images").alias("field"), "piece_idx", F.when(F.col("piece_idx") > 0, shared).otherwise(0).alias("shared"), F.lit(None).cast("string").alias("piece"), "images")
    return texts.unionByName(lists).dropDuplicates(["row_id", "turn_idx", "field", "piece_idx"])


def described_pieces(pieces: DataFrame, limit: int = IMAGE_LIMIT, shared: int = SHARED) -> DataFrame:
    """The pieces with, in place of `images`, the position of a slice's first image, their number, and a digest of their bytes."""
    digest = F.md5(F.array_join(F.transform("images", lambda i: F.coalesce(F.md5(i["bytes"]), F.lit("-"))), " "))
    first = F.when(F.col("images").isNotNull(), F.col("piece_idx") * (limit - shared))
    return pieces.withColumn("first_image", first).withColumn("n_images", F.when(F.col("images").isNotNull(), F.size("images"))).withColumn("digest", digest).drop("images")


def oversized_items(docs: DataFrame) -> DataFrame:
    """row_id, turn_idx, field of the items that come out in more than one piece."""
    return split_oversized(docs).where("piece_idx = 1").select("row_id", "turn_idx", "field")
