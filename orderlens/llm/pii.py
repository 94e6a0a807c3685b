"""Personal data and information-theoretic sanitisation, in DataFrame operations alone.

Base spans are e-mail addresses, IP addresses, card and phone numbers, by the
patterns below (leftmost, not overlapping within a kind; a match that fails
its check is dropped).  Each distinct value is a protected entity.

All words of a document that has an entity are its terms, of any length and
script, with inner hyphens and apostrophes.  Over the corpus, ``n(t, e)``
documents have term t and entity e, ``n(t)`` have t and ``n(e)`` have e, of N.
With the information content
``IC(e) = -log2(n(e) / N)`` and ``PMI(t, e) = log2(n(t, e) N / (n(t) n(e)))``
a term discloses the share ``PMI / IC`` of the entity.  Terms of at least
SUPPORT common documents whose share reaches REMOVE are removed wherever they
stand in the documents with that entity, outside its base spans; from
GENERALISE on they are generalised to their first letter.  Left out before
pairs are counted is only what cannot qualify: entities of fewer documents, and
terms in more documents than ``n(e) ** GENERALISE * N ** (1 - GENERALISE)``
allows for the most frequent entity.

Places in a text follow from the lengths of the parts between matches, summed
in windows of one document's matches, so that no document is held in an array
of its own length squared.

Cases: null text is empty and has no spans; each input row gives one output
row, so repeated rows and null ids stay; an empty table gives no rows; offsets
count code points; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.session import ensure_checkpoint_dir

# --- fixed values: the kinds in order, and their patterns --------------------
# Same matches as the plain patterns; possessive, and tried only at the start of
# a run or where the last match ended, so that long runs cost linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
#: A text that lacks this cannot have a match of the kind.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A term: letters with their marks, and hyphens and apostrophes between them.
WORD = r"\p{L}[\p{L}\p{M}]*+(?:['\u2019\u2010-]\p{L}[\p{L}\p{M}]*+)*+"
#: Documents that must share a term and an entity; share of the entity's
#: information from which a term is generalised, and removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.9
#: Parts that the documents of one entity are dealt to.
SALTS = 16


def _valid() -> Column:
    digits = "regexp_replace(match, '[^0-9]', '')"
    luhn = f"""aggregate(sequence(1, length({digits})), 0L, (s, j) -> s + case when j % 2 = 1 then cast(substr({digits}, -j, 1) as int)
                 else cast(substr({digits}, -j, 1) as int) * 2 div 10 + cast(substr({digits}, -j, 1) as int) * 2 % 10 end) % 10 = 0"""
    return F.expr(f"""case kind when 'email' then true
        when 'ip' then forall(split(match, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)
        when 'card' then case when length({digits}) between 14 and 19 then {luhn} else false end
        else length({digits}) between 10 and 15 end""")


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def parts_of(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str], needs: dict[str, str], reach: int, keep: bool = False) -> DataFrame:
    """For each row a line of its own (kind null) and, for each kind, the parts
    of its text before each match and after the last, with the match.  With
    ``keep``, the line of its own has the text, if there is any match."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = rows.select("*", *[F.when(F.col("text").rlike(needs[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in patterns.items()])
    whole = F.when(F.greatest(F.lit(0), *[F.size(f"m_{k}") for k in patterns]) > 0, F.col("text")) if keep else F.lit(None).cast("string")
    cut = found.select("row", "doc_id", whole.alias("whole"), *[f"m_{k}" for k in patterns],
                       *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"p_{k}") for k, p in patterns.items()])
    line = "struct<kind:string,i:int,part:string,match:string>"
    zipped = [F.when(F.size(f"p_{k}") > 0, F.arrays_zip(F.array_repeat(F.lit(k), F.size(f"p_{k}")), F.sequence(F.lit(0), F.size(f"p_{k}") - 1), f"p_{k}", f"m_{k}"))
              .otherwise(F.array()).cast(f"array<{line}>") for k in patterns]
    own = F.array(F.struct(F.lit(None).cast("string"), F.lit(0), F.col("whole"), F.lit(None).cast("string"))).cast(f"array<{line}>")
    lines = cut.select("row", "doc_id", F.explode(F.concat(own, *zipped)).alias("x"))
    return lines.select("row", "doc_id", F.col("x.kind").alias("kind"), F.col("x.i").alias("i"), F.length("x.part").alias("gap"), F.left("x.part", F.lit(reach)).alias("head"),
                        F.right("x.part", F.lit(reach)).alias("tail"), F.col("x.match").alias("match"), *([F.when(F.col("x.kind").isNull(), F.col("x.part")).alias("text")] if keep else []))


def _spans(parts: DataFrame) -> DataFrame:
    """Valid base spans: (row, kind, start, end, match)."""
    w = Window.partitionBy("row", "kind").orderBy("i")
    placed = parts.filter("kind is not null").select(
        "*", F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    return placed.filter(F.col("match").isNotNull()).filter(_valid()).select(
        "row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def _entities(spans: DataFrame) -> DataFrame:
    """(row, entity, n_e) of the entities in at least SUPPORT rows; an entity in
    many rows is met in SALTS parts."""
    name = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", "")))
    each = spans.select("row", F.xxhash64(name).alias("entity")).distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    many = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= SUPPORT)
    return each.join(many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["entity", "salt"]).select("row", "entity", "n_e")


def _words(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda w: F.xxhash64(w))


def _frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, n_t): documents that have a term, by the hash of the term."""
    each = docs.select(F.explode(_words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("h"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t") >= SUPPORT)


def disclosures(docs: DataFrame, texts: DataFrame, entities: DataFrame, total: int, text_col: str) -> DataFrame:
    """(entity, h, share, action) of the terms that disclose too much; texts:
    (row, text) of the rows with entities."""
    most = entities.agg(F.max("n_e")).first()[0] or 1
    bound = 1.001 * most ** GENERALISE * max(1, total) ** (1 - GENERALISE)
    known = _frequencies(docs, text_col).checkpoint()
    # a fixed number of rows at most: a document has its share of them
    common = known.filter(F.col("n_t") > max(bound, total / 1000)).select("h")
    terms = texts.join(entities.select("row").distinct(), "row", "left_semi").select("row", F.explode(_words(F.col("text"))).alias("h")).join(F.broadcast(common), "h", "left_anti")
    pairs = terms.join(entities, "row").groupBy("entity", "h").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_e").alias("n_e")).filter(F.col("n_te") >= SUPPORT)
    rated = pairs.join(known.filter(F.col("n_t") <= bound), "h").withColumn("n", F.lit(total))
    share = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))) / F.greatest(-F.log2(F.col("n_e") / F.col("n")), F.lit(1e-9))
    return rated.withColumn("share", share).filter(F.col("share") >= GENERALISE).select(
        "entity", "h", "share", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def _marked(texts: DataFrame, base: DataFrame, entities: DataFrame, hidden: DataFrame) -> DataFrame:
    """(row, start, end, action) of all occurrences of the disclosing terms in
    the rows with their entity, outside base spans."""
    by_entity = hidden.groupBy("entity").agg(F.collect_list(F.struct("h", "action")).alias("terms"))
    each = entities.join(by_entity, "entity").select("row", F.explode("terms").alias("t")).groupBy("row", F.col("t.h").alias("h")).agg(F.max("t.action").alias("action"))
    each = each.checkpoint()
    lines = parts_of(texts.join(each.select("row").distinct(), "row", "left_semi"), "row", "text", {"word": WORD}, {"word": r"\p{L}"}, 0).filter("kind is not null")
    w = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(w)).filter("match is not null").select(
        F.col("doc_id").alias("row"), F.xxhash64(F.lower("match")).alias("h"), (F.col("end") - F.length("match")).alias("start"), "end")
    found = placed.join(each, ["row", "h"]).select("row", "start", "end", "action")
    inside = base.select(F.col("row").alias("r"), F.col("start").alias("a"), F.col("end").alias("b"))
    return found.join(inside, (F.col("row") == F.col("r")) & (F.col("start") < F.col("b")) & (F.col("end") > F.col("a")), "left_anti")


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a number for each input row with its id, and all spans
    as (row, kind, start, end, action).  The lines of matches are written to
    the checkpoint folder once, which fixes the row numbers."""
    ensure_checkpoint_dir(spark)
    parts = parts_of(docs, id_col, text_col, PATTERNS, _NEEDS, 0, keep=True).checkpoint()
    rows = parts.filter("kind is null").select("row", "doc_id")
    base = _spans(parts).checkpoint()
    texts = parts.filter("kind is null and text is not null").select("row", "text")
    entities = _entities(base).checkpoint()
    hidden = disclosures(docs, texts, entities, rows.count(), text_col)
    added = _marked(texts, base, entities, hidden).select("row", F.lit("term").alias("kind"), "start", "end", "action")
    return rows, base.select("row", "kind", "start", "end", F.lit("remove").alias("action")).unionByName(added)


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted (start, kind number, end), comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    rows, spans = find(spark, docs)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    lines = spans.select("row", F.lit(None).cast("long").alias("doc_id"), F.struct("start", number.alias("k"), "end").alias("s")).unionByName(
        rows.select("row", "doc_id", F.lit(None).cast("struct<start:long,k:int,end:long>").alias("s")))
    by_row = lines.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda s: s["k"] == k)).cast("long")
    base = F.filter("s", lambda s: s["k"] < 4)
    return by_row.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"),
                         count(4).alias("n_term"))


def sanitise(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with base spans replaced by their kind, disclosing terms
    removed or generalised to their first letter."""
    ensure_checkpoint_dir(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "copy", F.monotonically_increasing_id()).checkpoint()
    rows, spans = find(spark, own, "copy")
    by_row = spans.join(rows, "row").groupBy(F.col("doc_id").alias("copy")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "action"))).alias("s"))
    # parts between spans, with what stands for each span; of overlapping
    # spans the later begins where the earlier ends
    text = F.expr("""aggregate(s, struct('' as done, 0L as at), (a, x) -> struct(
        concat(a.done, substr(text, cast(a.at as int) + 1, cast(greatest(x.start - a.at, 0) as int)),
               case when x.end <= a.at then '' when x.kind <> 'term' then concat('[', upper(x.kind), ']')
                    when x.action = 'remove' then '[TERM]' else concat(substr(text, cast(x.start as int) + 1, 1), '...') end) as done,
        greatest(a.at, x.end) as at), a -> concat(a.done, substr(text, cast(a.at as int) + 1)))""")
    return own.join(by_row, "copy", "left").select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(text).alias("text"))
