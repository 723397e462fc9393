"""Document fingerprints by I-Match.

Of each document's distinct terms, those within a band of inverse document frequency are kept, sorted, and hashed once
for each of several randomised subsets of the lexicon. Subsets range from the whole band to a small share of it, so
that texts of any length that differ in some terms still agree in some hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WORD, cut

#: Subsets: a term is in one of level n with chance 1 / 2**n. REPLICAS rows of nested subsets, each drawn by LEVELS bits of a term's hash.
LEVELS, REPLICAS = 10, 6
#: The band: a term's share of all documents, at least and at most.
RAREST, COMMONEST = 0.001, 0.2
#: Documents in a run of neighbours, and the most parts that the ids, and then each of these parts, are cut into.
RUN, MOST_PARTS = 256, 1024


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), NOT_WORD))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, text_col: str = "text") -> DataFrame:
    """(h): hashes of the terms within the band, counted over all documents.

    Size bound: at most (mean number of distinct terms of a document) / rarest terms are in that share of the
    documents, however many documents there are.
    """
    n = docs.count()
    least, most = max(2, round(rarest * n)), max(2, commonest * n)
    seen = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t")).filter("t <> ''").groupBy(F.xxhash64("t").alias("h")).agg(F.count("*").alias("df"))
    return cut(seen.filter((F.col("df") >= least) & (F.col("df") <= most)).select("h").repartition(8))


def _components(rows: DataFrame, ordered: list[str], alone: list[str], out: list[str]) -> DataFrame:
    """rows with arrays of a hash for each subset of the sorted terms: null where it has none. No terms at all: the text's own hash in all.

    The first hash is of all terms. Each level halves the sets of the level before, so a term is looked at about twice a replica.
    """
    sets = {(c, r): c for c in ordered for r in range(REPLICAS)}
    columns = rows.columns
    for level in range(1, LEVELS + 1):
        clear = lambda r, level=level: lambda t: t.bitwiseAND(F.lit(1 << (LEVELS * r + level - 1))) == 0
        names = {k: f"__{k[0]}_{k[1]}" for k in sets}
        halved = [F.filter(F.col(sets[k]), clear(k[1])).alias(names[k]) for k in sets]
        hashed = [F.when(F.size(sets[k]) > 0, F.xxhash64(sets[k], F.lit(k[1]))).alias(f"__{k[0]}_{k[1]}_{level - 1}") for k in sets if level > 1 or not k[1]]
        rows = rows.select(*[c for c in rows.columns if c not in names.values()], *hashed, *halved)
        sets = names
    parts = lambda c: F.array(F.col(f"__{c}_0_0"), *[F.col(f"__{c}_{r}_{level}") for level in range(1, LEVELS) for r in range(REPLICAS)], *[F.when(F.size(f"__{c}_{r}") > 0, F.xxhash64(f"__{c}_{r}", F.lit(r))) for r in range(REPLICAS)])
    n = 1 + LEVELS * REPLICAS
    return rows.select(*columns, *[F.when(F.size(c) > 0, parts(c)).otherwise(F.array_repeat(F.col(h), n)).alias(o) for c, h, o in zip(ordered, alone, out, strict=True)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that have terms in either text (0 to 1)."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    either = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(either > 0, equal / either).otherwise(F.lit(0.0)).cast("double")


def as_text(parts: Column) -> Column:
    """The hashes in hexadecimal, joined; a subset without terms is a dash."""
    return F.array_join(F.transform(parts, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-"))), ".")


def fingerprints(rows: DataFrame, key: list[str], texts: list[str], lex: DataFrame, carry: list[str], limit: int = 1_000_000) -> DataFrame:
    """(key, carry, fp0, fp1...): arrays of hashes of the text columns; a null text's is null. key must tell rows apart.

    Rows stay where they are if they are partitioned by (some of) key. lex is broadcast when it has at most limit
    rows (its size bound makes that the rule), else joined by its hash. Equal texts have equal fingerprints; texts that
    have no term of lex are told apart by a hash of the whole text.
    """
    each = range(len(texts))
    sized = rows.select(*key, F.struct(*carry, *[F.xxhash64(F.lower(F.col(t))).alias(f"__h{i}") for i, t in enumerate(texts)], *[F.col(t).isNull().alias(f"__n{i}") for i, t in enumerate(texts)]).alias("__own"), *[F.coalesce(terms(F.col(t)), F.array().cast("array<string>")).alias(f"__t{i}") for i, t in enumerate(texts)])
    # place 0 stands for the row itself
    ends = [sum((F.size(f"__t{j}") for j in range(i + 1)), F.lit(0)) for i in each]
    flat = sized.select(*key, "__own", *[e.alias(f"__e{i}") for i, e in enumerate(ends)], F.posexplode(F.concat(F.array(F.lit("")), *[F.col(f"__t{i}") for i in each])).alias("__at", "__term"))
    which = F.coalesce(*[F.when(F.col("__at") <= F.col(f"__e{i}"), F.lit(i)) for i in each])
    own = F.col("__at") == 0
    flat = flat.select(*key, F.when(own, F.col("__own")).alias("__own"), F.when(own, F.lit(-1)).otherwise(which).alias("__which"), F.xxhash64("__term").alias("h"))
    known = lex.select("h", F.lit(True).alias("__in"))
    known = F.broadcast(known) if lex.count() <= limit else known
    found = flat.join(known, "h", "left").filter((F.col("__which") < 0) | F.col("__in"))
    grouped = found.groupBy(*key).agg(F.first("__own", ignorenulls=True).alias("__own"), *[F.collect_list(F.when(F.col("__which") == i, F.col("h"))).alias(f"__f{i}") for i in each])
    ordered = grouped.select(*key, "__own.*", *[F.sort_array(f"__f{i}").alias(f"__f{i}") for i in each])
    hashed = _components(ordered, [f"__f{i}" for i in each], [f"__h{i}" for i in each], [f"fp{i}" for i in each])
    return hashed.select(*key, *carry, *[F.when(~F.col(f"__n{i}"), F.col(f"fp{i}")).alias(f"fp{i}") for i in each])


def in_runs(rows: DataFrame, id_col: str, tie_col: str, run: int) -> DataFrame:
    """rows with run (long) and ghost (boolean): runs of about `run` neighbours by descending id, each with its successor as a ghost.

    The ids are cut at quantiles, and each part again at its own, so runs are of like size however the ids cluster; rows
    of one id share a run. Every cut is the greatest id of its run, so the row that follows a run's last is known without
    looking: it is also sent there, as a ghost (rows of the same id with it). The greatest id of all follows the least.
    Rows without an id come last, in the order of tie_col (long), spread by it.
    """
    least = rows.agg(F.min(F.col(id_col).cast("double"))).first()[0] or 0.0
    spread = F.shiftrightunsigned(tie_col, 12).cast("double") / float(1 << 52)
    # unsigned order of tie_col: negative ones behind
    q = F.coalesce(F.col(id_col).cast("double"), F.lit(least) - F.lit(max(1.0, abs(least))) * (1 + spread))
    rows = rows.withColumn("__q", q)
    n = rows.count()
    parts = max(1, min(MOST_PARTS, int((n / run) ** 0.5)))
    within = max(1, min(MOST_PARTS, -(-n // (run * parts))))

    def cuts(of: DataFrame, k: int) -> DataFrame:
        inner = F.percentile_approx("__q", [j / k for j in range(1, k)], 100 * k) if k > 1 else F.array().cast("array<double>")
        return of.agg(F.array_sort(F.array_distinct(F.concat(inner, F.array(F.max("__q"))))).alias("__cuts"))

    below = lambda cuts_: F.size(F.filter(cuts_, lambda c: c < F.col("__q"))).cast("long")
    edges = cuts(rows.groupBy(), parts).first()[0] if n else []
    outer = F.array(*[F.lit(x) for x in edges]).cast("array<double>")
    rows = rows.withColumn("__part", below(outer))
    # one row for each part, at most MOST_PARTS
    inner = cuts(rows.groupBy("__part"), within)
    rows = rows.join(F.broadcast(inner), "__part").withColumn("__sub", below(F.col("__cuts")))
    at = F.col("__part") * MOST_PARTS * 2 + F.col("__sub")
    is_cut = F.get("__cuts", F.col("__sub")) == F.col("__q")
    above = F.when(F.col("__sub") + 1 < F.size("__cuts"), at + 1).when(F.col("__part") + 1 < len(edges), (F.col("__part") + 1) * MOST_PARTS * 2).otherwise(0)
    places = F.when(is_cut, F.array(F.struct(at.alias("run"), F.lit(False).alias("ghost")), F.struct(above.alias("run"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(at.alias("run"), F.lit(False).alias("ghost"))))
    return rows.withColumn("__place", F.explode(places)).select(*[c for c in rows.columns if not c.startswith("__")], "__place.run", "__place.ghost")


def next_edit(text: Column, following: Column) -> Column:
    """text with its last third (rounded down) replaced by the first as many characters of following."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def compare_with_edits(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id (rows of one id follow by a hash of their texts, unsigned; null ids come
    last); after the last row comes the first. Null texts are empty. An empty table gives no rows. Ids are integers. Texts
    travel once, to runs of neighbouring ids.
    """
    lex = lexicon(docs, rarest, commonest, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    lined = in_runs(rows, "doc_id", "tie", RUN)
    # ~id and the flipped sign put greater ids and unsigned order first
    order = ["ghost", F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("tie").bitwiseXOR(F.lit(-(1 << 63)))]
    in_run = W.partitionBy("run").orderBy(*order)
    lined = lined.select("run", "ghost", "doc_id", "text", F.lead("text").over(in_run).alias("following"), F.row_number().over(in_run).alias("place"))
    edited = lined.withColumn("edited", F.when(~F.col("ghost"), next_edit(F.col("text"), F.col("following"))))
    edited = edited.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    found = fingerprints(edited, ["run", "place"], ["text", "edited"], lex, ["doc_id", "n_chars", "edited_sha256", "ghost"])
    found = found.withColumn("next_fp", F.lead("fp0").over(W.partitionBy("run").orderBy("place"))).filter(~F.col("ghost"))
    return found.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("fp0")).alias("fingerprint"), as_text(F.col("fp1")).alias("edited_fingerprint"),
        likeness(F.col("fp0"), F.col("fp1")).alias("near_edited"), likeness(F.col("fp0"), F.col("next_fp")).alias("near_next"),
    )
