"""Search over many terms at once by an inverted index of three- and six-letter grams.

A text is its name and what follows it, and many texts share either of them: a player's name stands before every team of the player, a
team's context behind every player of the team. ``build`` numbers the texts in the order of their names and indexes each different
name and each different context once, as *parts*. ``search`` takes the terms as a frame: a term is looked up by its rarest gram, the
parts found there are checked for the whole term, and the first rows of the best parts are kept. A term that reaches from a name into
its context is looked up by where it is cut: the end of a name or the beginning of a context, whichever fewer have. For terms of one or
two letters the answers themselves are stored. No text meets a term that shares no gram with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanteo.functions.text import normalize_text, spanish
from tanteo.operators.ranking import ranked, top_per_group
from tanteo.session import cut
from tanteo.sources.snapshots import Entry, Layout, SnapshotStore

#: Letters of a gram: a term is looked up by the longest that it can hold.
GRAM, LONG_GRAM = 3, 6
#: Letters by which the end of a name and the beginning of a context are looked up.
EDGE = 12
#: Answers kept for each short term, and rows of each part: the most that a search can ask for.
SHORT_ANSWERS = 50
#: A term's letters are numbered below this; the rest of the number is the size of a gram's list.
_PLACES = 1 << 20
TABLES = (
    "search_rows", "search_parts", "search_texts", "search_postings", "search_grams", "search_edges", "search_edge_sizes", "search_short",
)
#: Sides of a text; as the first letter of a gram or an edge, they keep those of names and of contexts apart.
_NAME, _CONTEXT = "0", "1"


def _grams(text: Column, n: int | Column) -> Column:
    """All runs of ``n`` letters, in order."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def _rank(text: str = "normalized") -> Column:
    return F.when(F.col(text) == F.col("term"), 0).when(F.col(text).startswith(F.col("term")), 1).otherwise(2)


def _part_rank() -> Column:
    """Rank of the rows of a part that holds the term, as far as the part tells. It is the same for all of them."""
    return F.when(F.col("side") == _CONTEXT, 2).when(F.col("bare") | (F.col("text") != F.col("term")), _rank("text")).otherwise(1)


def _head_length() -> Column:
    """Letters of the text that are its name; all of them if it does not begin with the name."""
    name = normalize_text(F.col("name"))
    return F.when((name != "") & F.col("normalized").startswith(name), F.length(name)).otherwise(F.length("normalized"))


def _head() -> Column:
    return F.substring("normalized", F.lit(1), F.col("head_length"))


def _tail() -> Column:
    return F.substring("normalized", F.col("head_length") + 1, F.length("normalized"))


def _parts(rows: DataFrame) -> DataFrame:
    """Each different name and context with its first rows. A name with nothing behind it is a part of its own: it may be a whole term."""
    sides = F.array(
        F.struct(F.lit(_NAME).alias("side"), _head().alias("text"), (_tail() == "").alias("bare")),
        F.struct(F.lit(_CONTEXT).alias("side"), _tail().alias("text"), F.lit(False).alias("bare")),
    )
    of_part = ["side", "text", "bare"]
    first = top_per_group(rows.select("row_id", F.inline(sides)).where("text != ''"), of_part, [F.asc("row_id")], SHORT_ANSWERS)
    # A part is named by its first row. Its rows are few by now.
    whole = Window.partitionBy(*of_part)
    number = F.min("row_id").over(whole) * 2 + F.col("side").cast("bigint")
    return first.select(
        number.alias("part_id"), "row_id", "pos", F.count("*").over(whole).alias("rows"), "side", "bare",
        F.when(F.col("pos") == 1, F.col("text")).alias("text"),
    )


def _best_parts(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` parts of each term and side. A part that has ``k`` better ones has no row among the best ``k``."""
    return top_per_group(found.withColumn("rank", _part_rank()), ["term", "side"], [F.asc("rank"), F.asc("part_id")], k).drop("pos")


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of each term: exact, then prefix, then contained; then by number, which follows the names."""
    once = found.groupBy("term", "row_id").agg(F.min("rank").alias("rank"))
    return top_per_group(once, ["term"], [F.asc("rank"), F.asc("row_id")], k)


def _first_rows(best: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    return best.join(parts.where(F.col("pos") <= k).select("part_id", "row_id"), "part_id").select("term", "rank", "row_id")


def _short_answers(rows: DataFrame, parts: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of every term of one or two letters."""
    short = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM)]))
    best = _best_parts(texts.withColumn("term", F.explode(short)), k)
    across = rows.where(F.col("head_length") < F.length("normalized"))
    across = across.withColumn("term", F.substring("normalized", F.col("head_length"), F.lit(GRAM - 1)))
    across = top_per_group(across.select("term", _rank().alias("rank"), "row_id"), ["term"], [F.asc("rank"), F.asc("row_id")], k)
    return _best_rows(_first_rows(best, parts, k).unionByName(across.drop("pos")), k)


def build(store: SnapshotStore, texts: DataFrame, run: tuple[str, int] = ("search", 1), buckets: int | None = None) -> None:
    """Store the index of ``texts`` (``directory.search_index``); a run that was applied before changes nothing."""
    if store.is_applied(run):
        return
    buckets = buckets or int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    entries: dict[str, Entry] = {}

    def staged(name: str, frame: DataFrame, *key: str) -> DataFrame:
        entries[name] = store.stage(name, frame, Layout((), key, buckets) if key else Layout())
        return store.open(entries[name])

    # Numbered in the order of the names, once: no answer is put in order by its name again.
    order = [spanish(F.col("name")).asc(), F.asc("type"), F.asc("id"), F.asc_nulls_first("team_id")]
    rows = staged("search_rows", ranked(texts.withColumn("head_length", _head_length()), [], order, "row_id"))
    parts = staged("search_parts", _parts(rows))
    different = staged("search_texts", parts.where("pos = 1").select("part_id", "side", "bare", "text", "rows"), "part_id")
    grams = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in (GRAM, LONG_GRAM)]))
    postings = different.select("side", F.explode(grams).alias("gram"), "part_id")
    postings = staged("search_postings", postings.select(F.concat("side", "gram").alias("gram"), "part_id"), "gram")
    staged("search_grams", postings.groupBy("gram").agg(F.count("*").alias("texts")), "gram")
    lengths = F.sequence(F.lit(1), F.least(F.length("text"), F.lit(EDGE)))
    ends = F.when(F.col("side") == _NAME, F.transform(lengths, lambda n: F.right("text", n)))
    edges = F.explode(ends.otherwise(F.transform(lengths, lambda n: F.left("text", n)))).alias("edge")
    edges = different.where("not bare").select("side", edges, "part_id", "rows")
    edges = staged("search_edges", edges.select(F.concat("side", "edge").alias("edge"), "part_id", "rows"), "edge")
    staged("search_edge_sizes", edges.groupBy("edge").agg(F.sum("rows").alias("rows")), "edge")
    staged("search_short", _short_answers(rows, parts, different, SHORT_ANSWERS), "term")
    store.publish(run, entries)


def _inside(terms: DataFrame, postings: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Terms beside the parts that hold them."""
    width = F.when(F.length("term") >= LONG_GRAM, LONG_GRAM).otherwise(GRAM)
    asked = terms.select("term", F.posexplode(_grams(F.col("term"), width)).alias("at", "letters"))
    asked = asked.select("term", "at", F.explode(F.array(F.lit(_NAME), F.lit(_CONTEXT))).alias("side"), "letters")
    sized = asked.withColumn("gram", F.concat("side", "letters")).join(sizes, "gram")
    # Size and place in one number: its minimum is the rarest gram. A gram that no part has leaves a term without answers there.
    rarest = sized.groupBy("term", "side").agg(
        F.min(F.col("texts") * _PLACES + F.col("at")).alias("best"), F.count("*").alias("known")
    ).where(F.col("known") == F.length("term") - width + 1)
    place = (F.col("best") % _PLACES).cast("int")
    chosen = rarest.select("term", F.concat("side", F.substring(F.col("term"), place + 1, width)).alias("gram"))
    candidates = chosen.join(postings, "gram").select("term", "part_id")
    return candidates.join(texts, "part_id").where(F.contains("text", "term"))


def _across(terms: DataFrame, edges: DataFrame, sizes: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Terms beside the rows in which they reach from the name into the context."""
    cuts = terms.select("term", F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("at"))
    cuts = cuts.select(
        "term", F.concat(F.lit(_NAME), F.right(F.substring("term", F.lit(1), F.col("at")), F.lit(EDGE))).alias("end"),
        F.concat(F.lit(_CONTEXT), F.substring("term", F.col("at") + 1, F.lit(EDGE))).alias("start"),
    )
    for side in ("start", "end"):
        cuts = cuts.join(sizes.select(F.col("edge").alias(side), F.col("rows").alias(f"{side}_rows")), side)
    fewer = F.when(F.col("end_rows") <= F.col("start_rows"), F.col("end")).otherwise(F.col("start"))
    near = cuts.select("term", fewer.alias("edge")).distinct().join(edges.select("edge", "part_id"), "edge").select("term", "part_id")
    # Stored, so that few of them are known to be few before the rows are read.
    near = cut(near.join(texts, "part_id").select("term", "side", "text"))
    sides = {_NAME: _head(), _CONTEXT: _tail()}
    met = [
        rows.select("row_id", "normalized", text.alias("text")).join(near.where(F.col("side") == side).drop("side"), "text")
        for side, text in sides.items()
    ]
    return met[0].unionByName(met[1]).where(F.contains("normalized", "term")).select("term", _rank().alias("rank"), "row_id")


def search(store: SnapshotStore, terms: DataFrame, k: int = 12) -> DataFrame:
    """Best ``k`` texts of each different term (column ``term``, normalised in the result); blank terms have none."""
    if k > SHORT_ANSWERS:
        raise ValueError(f"the index keeps {SHORT_ANSWERS} answers of a short term")
    rows, parts, texts, postings, grams, edges, edge_sizes, short = (store.read(name) for name in TABLES)
    wanted = terms.select(normalize_text(F.col("term")).alias("term")).where("term != ''").distinct()
    brief = short.join(wanted.where(F.length("term") < GRAM), "term", "left_semi").where(F.col("pos") <= k)
    asked = wanted.where(F.length("term") >= GRAM)
    inside = _first_rows(_best_parts(_inside(asked, postings, grams, texts), k), parts, k)
    across = _across(asked, edges, edge_sizes, texts, rows)
    # Stored, so that few answers are known to be few before the rows are read.
    best = cut(_best_rows(inside.unionByName(across), k).unionByName(brief.select("term", "row_id", "rank", "pos")))
    return rows.drop("head_length").join(best, "row_id")
