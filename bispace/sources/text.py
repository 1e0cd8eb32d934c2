"""Text files of receptors, clones, kernel components and distances, read and written by Spark.

Readers leave folders of many files to Spark's own splits; nothing is opened on the driver. Writers
give one folder of part files each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other names that columns of clone and literature tables go by.
ALIASES = {"va": "va_gene", "ja": "ja_gene", "vb": "vb_gene", "jb": "jb_gene"}
#: Columns that a table of clones needs.
CLONE_COLUMNS = ["clone_id", "va_gene", "ja_gene", "cdr3a", "cdr3a_nucseq", "vb_gene", "jb_gene", "cdr3b", "cdr3b_nucseq"]
#: The 20 amino acids in the order of distance tables.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def _table(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def with_aliases(df: DataFrame) -> DataFrame:
    """Columns of other names under their usual ones, unless those are there already."""
    for other, usual in ALIASES.items():
        if other in df.columns and usual not in df.columns:
            df = df.withColumnRenamed(other, usual)
    return df


def need(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def read_clones(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Clones, one row each; sizes and UMI counts as whole numbers, the rest as text."""
    df = need(with_aliases(_table(spark, path, sep)), CLONE_COLUMNS)
    numbers = [c for c in df.columns if c == "clone_size" or c.endswith("_umi") or c.startswith("num_")]
    return df.withColumns({c: F.col(c).cast("long") for c in numbers})


def write_clones(clones: DataFrame, path: str) -> None:
    clones.write.option("header", True).option("sep", "\t").csv(path)


def read_barcode_map(spark: SparkSession, path: str) -> DataFrame:
    """(clone_id, barcodes array) from comma lists; an empty list is an empty array."""
    df = need(_table(spark, path, "\t"), ["clone_id", "barcodes"])
    return df.select("clone_id", F.filter(F.split(F.coalesce("barcodes", F.lit("")), ","), lambda b: b != "").alias("barcodes"))


def write_barcode_map(rows: DataFrame, path: str) -> None:
    """From (clone_id, barcodes array)."""
    lists = rows.select("clone_id", F.concat_ws(",", F.array_sort("barcodes")).alias("barcodes"))
    lists.write.option("header", True).option("sep", "\t").csv(path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(clone, barcode, chain, v_gene, j_gene, cdr3, cdr3_nt, umis, productive) of contigs in a clonotype."""
    df = need(_table(spark, path, ","), ["barcode", "chain", "v_gene", "j_gene", "cdr3", "cdr3_nt", "umis", "productive", "raw_clonotype_id"])
    said = F.lower(F.trim("productive"))
    known = ~F.lower(F.coalesce("raw_clonotype_id", F.lit("none"))).isin("none", "nan", "")
    return df.where(known).select(
        F.col("raw_clonotype_id").alias("clone"), "barcode", "chain", "v_gene", "j_gene", "cdr3", "cdr3_nt", F.col("umis").cast("long").alias("umis"),
        said.isin("true", "t", "1", "yes").alias("productive"),
    )


def read_kernel_components(spark: SparkSession, path: str) -> DataFrame:
    """(clone_id, kpc array<double>) from lines ``pc_comps: id v1 v2 ...``; other lines are no rows."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("pc_comps:")).select(parts.alias("p"))
    return rows.select(F.col("p")[1].alias("clone_id"), F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0))).cast("array<double>").alias("kpc"))


def write_kernel_components(rows: DataFrame, path: str) -> None:
    numbers = F.concat_ws(" ", F.transform("kpc", lambda x: F.format_string("%.6f", x)))
    rows.select(F.concat_ws(" ", F.lit("pc_comps:"), F.col("clone_id").cast("string"), numbers).alias("value")).write.text(path)


def read_letter_distances(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) from lines ``AAdist a d1 ... d20``, in the usual order of amino acids."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("AAdist")).select(parts.alias("p"))
    each = rows.select(F.col("p")[1].alias("a"), F.posexplode(F.slice("p", 3, 20)).alias("at", "d"))
    return each.select("a", F.substring(F.lit(AMINO_ACIDS), F.col("at") + 1, F.lit(1)).alias("b"), F.col("d").cast("double").alias("d"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Neighbour edges as Parquet, one folder for each space and fraction that they name."""
    edges.write.partitionBy(*[c for c in ("space", "nbr_frac") if c in edges.columns]).parquet(path)


# ---- expression, genes, distances, receptors ---------------------------------------------------
def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, _f, _s, _o) of text files, with the order of lines: file, start of the split, place in it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"))
    return rows.withColumn("_o", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(k, value): lines with their number from 1, counted by ranges of the order, never in one task."""
    from bispace.operators.windows import running_sum

    return running_sum(lines_of(spark, path), [], [F.col("_f"), F.col("_s"), F.col("_o")], F.lit(1), "k").select("k", "value")


def read_matrix(spark: SparkSession, path: str, unique_names: bool = True) -> DataFrame:
    """(cell, feature, feature_type, value) from a folder with matrix.mtx, features.tsv and barcodes.tsv
    (each may be compressed, or be a folder of parts): triplets of places from 1, names by line.

    Repeated feature names get ``-1``, ``-2`` in order of their lines with ``unique_names``. The first line
    that isn't a comment gives the number of entries; another number of them raises an error.
    """
    from pyspark.sql import Window

    parts = F.split("value", "\t")
    features = numbered_lines(spark, f"{path}/features.tsv*").select("k", F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]).alias("feature"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("Gene Expression")).alias("feature_type"))
    if unique_names:
        again = F.row_number().over(Window.partitionBy("feature").orderBy("k")) - 1
        features = features.withColumn("feature", F.when(again > 0, F.concat_ws("-", "feature", again.cast("string"))).otherwise(F.col("feature")))
    cells = numbered_lines(spark, f"{path}/barcodes.tsv*").select(F.col("k").alias("c"), F.trim("value").alias("cell"))
    entry = F.split(F.trim("value"), r"\s+")
    lines = lines_of(spark, f"{path}/matrix.mtx*").where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.orderBy("_f", "_s", "_o").limit(1).select("value", "_f", "_s", "_o").first()
    if head is None:
        raise ValueError(f"{path}: no line of sizes")
    rest = lines.where(~((F.col("_f") == head["_f"]) & (F.col("_s") == head["_s"]) & (F.col("_o") == head["_o"])))
    if int(head["value"].split()[2]) != rest.count():
        raise ValueError(f"{path}: {head['value'].split()[2]} entries announced")
    rows = rest.select(entry.alias("e")).select(F.col("e")[0].cast("long").alias("k"), F.col("e")[1].cast("long").alias("c"), F.col("e")[2].cast("double").alias("value"))
    return rows.join(features, "k").join(cells, "c").select("cell", "feature", "feature_type", "value")


def write_matrix(rows: DataFrame, path: str, feature_type: str = "Gene Expression") -> None:
    """A matrix folder of (cell, feature, value), one row a cell and feature, names in their order.

    matrix.mtx comes in two parts, its head and its entries.
    """
    from bispace.operators.windows import running_sum
    from bispace.session import work_table

    spark = rows.sparkSession
    number = lambda c: work_table(running_sum(rows.select(F.col(c).cast("string").alias(c)).distinct(), [], [F.col(c)], F.lit(1), "k"), c)
    features, cells = number("feature"), number("cell")
    entries = rows.select(F.col("cell").cast("string").alias("cell"), F.col("feature").cast("string").alias("feature"), "value")
    entries = entries.join(features.withColumnRenamed("k", "f"), "feature").join(cells.withColumnRenamed("k", "c"), "cell")
    head = f"{features.count()} {cells.count()} {rows.count()}"
    spark.createDataFrame([("%%MatrixMarket matrix coordinate real general\n" + head,)], "value string").coalesce(1).write.text(f"{path}/matrix.mtx-0")
    entries.select(F.concat_ws(" ", "f", "c", F.col("value").cast("string")).alias("value")).write.text(f"{path}/matrix.mtx-1")
    features.orderBy("k").select(F.concat_ws("\t", "feature", "feature", F.lit(feature_type)).alias("value")).write.text(f"{path}/features.tsv")
    cells.orderBy("k").select(F.col("cell").alias("value")).write.text(f"{path}/barcodes.tsv")


def read_expression(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(cell, feature, feature_type, value) from ``10x_mtx`` folders, or Parquet and CSV in long form.
    Binary single-file formats need another library and aren't read: convert them first."""
    if kind == "10x_mtx":
        return read_matrix(spark, path)
    if kind in ("parquet", "csv"):
        rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)
        rows = need(rows, ["cell", "feature", "value"]).withColumn("value", F.col("value").cast("double"))
        return rows if "feature_type" in rows.columns else rows.withColumn("feature_type", F.lit("Gene Expression"))
    raise ValueError(f"unknown kind of expression table: {kind}")


def read_genes(spark: SparkSession, path: str, organism: str) -> DataFrame:
    """(gene, chain, region, nuc, loops) of an organism's genes; loops without the CDR3's start, one space
    between. Rows whose bases don't translate to the aligned protein in their frame raise an error."""
    from bispace.functions.scores import translate

    t = need(_table(spark, path, "\t"), ["id", "organism", "chain", "region", "nucseq", "aligned_protseq", "cdrs", "frame"]).where(F.col("organism") == organism)
    cdrs = F.split("cdrs", ";")
    plain = F.replace("aligned_protseq", F.lit("."), F.lit(""))
    read = F.when(F.col("frame").cast("int") == 2, translate(F.col("nucseq"), 2)).when(F.col("frame").cast("int") == 3, translate(F.col("nucseq"), 3)).otherwise(translate(F.col("nucseq"), 1))
    bad = t.where(read != plain).select("id").limit(5).collect()
    if bad:
        raise ValueError("bases and protein differ: " + ", ".join(r["id"] for r in bad))
    loops = F.when(F.col("region") == "V", F.array_join(F.slice(cdrs, F.lit(1), F.greatest(F.size(cdrs) - 1, F.lit(0))), " "))
    return t.select(F.col("id").alias("gene"), "chain", "region", F.col("nucseq").alias("nuc"), loops.alias("loops"))


def read_v_distances(spark: SparkSession, path: str) -> DataFrame:
    """(chain, v1, v2, d) from lines ``V{A,B}dist gene d1 d2 ...``, in the order of the chain's own lines."""
    from pyspark.sql import Window

    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("o", F.monotonically_increasing_id()).where(F.col("value").rlike("^V[AB]dist")).select("o", parts.alias("p"))
    rows = rows.select(F.substring(F.col("p")[0], 2, 1).alias("chain"), F.col("p")[1].alias("v1"), F.slice("p", F.lit(3), F.size("p") - 2).alias("d"), F.row_number().over(Window.partitionBy(F.substring(F.col("p")[0], 2, 1)).orderBy("o")).alias("k"))
    each = rows.select("chain", "v1", F.posexplode("d").alias("at", "d"))
    return each.join(rows.select("chain", F.col("v1").alias("v2"), (F.col("k") - 1).alias("at")), ["chain", "at"]).select("chain", "v1", "v2", F.col("d").cast("double").alias("d"))


#: Names that columns of receptor files go by.
CHAIN_ALIASES = {"v": "v_gene", "va": "va_gene", "vb": "vb_gene", "j": "j_gene", "ja": "ja_gene", "jb": "jb_gene"}


def read_receptors(spark: SparkSession, path: str, v: DataFrame | None = None, paired: bool = True) -> DataFrame:
    """(id, va, cdr3a, vb, cdr3b) or (id, v, cdr3) by line from 0; any row with a CDR3 of under five letters
    or others than the 20, or a V gene without distances, raises an error that names some."""
    from pyspark.sql import Window

    df = _table(spark, path, "\t")
    for a, b in CHAIN_ALIASES.items():
        if b in df.columns and a not in df.columns:
            df = df.withColumnRenamed(b, a)
    chains = ["a", "b"] if paired else [""]
    df = need(df, [f"{k}{c}" for c in chains for k in ("v", "cdr3")]).withColumn("_o", F.monotonically_increasing_id())
    df = df.withColumn("id", (F.row_number().over(Window.orderBy("_o")) - 1).cast("long")).drop("_o")
    wrong = F.lit(False)
    for c in chains:
        wrong = wrong | ~F.coalesce(F.col(f"cdr3{c}").rlike(f"^[{AMINO_ACIDS}]{{5,}}$"), F.lit(False))
    bad = df.where(wrong).select("id").limit(5).collect()
    if v is not None:
        for c in chains:
            bad += df.join(F.broadcast(v.select(F.col("v1").alias(f"v{c}")).distinct()), f"v{c}", "left_anti").select("id").limit(5).collect()
    if bad:
        raise ValueError("bad receptors in rows " + ", ".join(str(r["id"]) for r in bad))
    return df


def read_literature(spark: SparkSession, path: str) -> DataFrame:
    """Receptors of a literature table, gene columns under their short names, with a line number ``db_id``."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    for a, b in ALIASES.items():
        if b in df.columns and a not in df.columns:
            df = df.withColumnRenamed(b, a)
    return need(df, ["va", "cdr3a", "vb", "cdr3b"]).withColumn("db_id", F.monotonically_increasing_id())


def read_letter_properties(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """Properties of the 20 amino acids by name, from a table with a column ``aa``."""
    rows = need(_table(spark, path, "\t"), ["aa"]).limit(21).collect()
    if sorted(r["aa"] for r in rows) != list(AMINO_ACIDS):
        raise ValueError(f"{path}: not the 20 amino acids")
    return {c: {r["aa"]: float(r[c]) for r in rows} for c in rows[0].asDict() if c != "aa"}


def read_logistic_model(spark: SparkSession, path: str) -> dict:
    """A chain's model from lines ``name value``: sizes, genes (``V name``, ``J name``), then weights."""
    lines = [r["value"].split() for r in spark.read.text(path).withColumn("o", F.monotonically_increasing_id()).orderBy("o").collect() if r["value"].strip()]  # one model
    sizes = {k: int(v) for k, v, *_ in lines if k in ("min_lenbin", "max_lenbin", "window_size", "NV", "NJ")}
    rest = [x for x in lines if x[0] not in sizes]
    names = lambda region: [k for k, *_ in rest if len(k) > 4 and k[:2] in ("TR", "IG") and k[3] == region]
    return {"v_genes": names("V"), "j_genes": names("J"), "min_len": sizes["min_lenbin"], "max_len": sizes["max_lenbin"], "window": sizes["window_size"], "weights": [float(x[-1]) for x in rest]}


def read_linear_model(spark: SparkSession, path: str) -> list[dict]:
    """Rows (feature, mean, var, coef, intercept) of a linear model with a coefficient."""
    rows = need(_table(spark, path, "\t"), ["feature", "mean", "var", "coef", "intercept"]).limit(10_000).collect()
    return [{k: r[k] if k == "feature" else float(r[k]) for k in ("feature", "mean", "var", "coef", "intercept")} for r in rows if abs(float(r["coef"])) > 1e-6]


def read_locus_order(spark: SparkSession, path: str) -> list[str]:
    """Genes by their place, from lines ``gene place ...``; the head line is skipped."""
    rows = [r["value"].split() for r in spark.read.text(path).limit(10_000).collect()]
    return [g for _, g in sorted((int(x[1]), x[0]) for x in rows if len(x) >= 2 and x[0] != "IMGT")]


def read_batches(spark: SparkSession, metadata: str, strip: str | None = "suffix", add: str | None = "suffix", delim: str = "-") -> DataFrame:
    """Contigs of all files of a table (file, batch_id), with their batch in barcodes and clones."""
    from bispace.operators.clones import with_batch

    sep = "," if metadata.endswith(".csv") else "\t"
    out = None
    for r in need(_table(spark, metadata, sep), ["file", "batch_id"]).collect():  # one row a file
        part = with_batch(read_contigs(spark, r["file"]), r["batch_id"], strip, add, delim)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"{metadata} names no files")
    return out


# ---- writers -----------------------------------------------------------------------------------
def write_generic_clones(receptors: DataFrame, path: str, subject: str = "UNK", epitope: str = "UNK_E") -> None:
    """Paired receptors (id, va, ja, cdr3a, nta, vb, jb, cdr3b, ntb) as clones ``clone_1``... by id."""
    from bispace.operators.windows import running_sum

    n = running_sum(receptors, [], [F.col("id")], F.lit(1), "_k")
    gene = [F.col(f"{x}{y}").alias(f"{x}{y}_{z}") for x in "vj" for y in "ab" for z in ("gene", "genes")]
    rows = n.select(F.concat(F.lit("clone_"), F.col("_k").cast("string")).alias("clone_id"), F.lit(subject).alias("subject"), F.lit(epitope).alias("epitope"), "cdr3a", F.col("nta").alias("cdr3a_nucseq"), "cdr3b", F.col("ntb").alias("cdr3b_nucseq"), *gene)
    write_clones(rows, path)


def write_result(rows: DataFrame, prefix: str, tag: str, help_text: str) -> None:
    """A result table as text, and a text beside it that says what it is."""
    rows.write.option("header", True).option("sep", "\t").csv(f"{prefix}_{tag}.tsv")
    rows.sparkSession.createDataFrame([(help_text,)], "value string").coalesce(1).write.text(f"{prefix}_{tag}_README.txt")


def read_edges(spark: SparkSession, path: str, space: str, fraction: float) -> DataFrame:
    """(src, dst, dist, rank) of one space and fraction of what write_edges wrote; both spaces must be there."""
    rows = need(spark.read.parquet(path), ["src", "dst", "space", "nbr_frac"]).where(F.round("nbr_frac", 6) == round(fraction, 6))
    there = {r[0] for r in rows.select("space").distinct().collect()}
    if not {"gex", "tcr"} <= there:
        raise ValueError(f"fraction {fraction:.6f} has graphs of {sorted(there)} only")
    return rows.where(F.col("space") == space).drop("space", "nbr_frac")


def write_neighbour_lines(edges: DataFrame, path: str) -> None:
    """A line for each node: its id and those of its neighbours, nearest first."""
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("n"))
    lists.select(F.concat_ws(" ", F.col("src").cast("string"), F.concat_ws(" ", F.col("n.dst").cast("array<string>"))).alias("value")).write.text(path)


def write_projection(nodes: DataFrame, path: str) -> None:
    """Lines of a node's coordinates, clusters and receptor (id, x, y, cg, ct, va, ja, cdr3a, vb, jb, cdr3b)."""
    named = [("clone", "id"), ("clusters_gex", "cg"), ("clusters_tcr", "ct")]
    parts = [F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in named] + [F.format_string("xy: %.3f %.3f", F.col("x"), F.col("y"))] + [F.col(c) for c in ("va", "ja", "cdr3a", "vb", "jb", "cdr3b")]
    nodes.select(F.concat_ws(" ", *parts).alias("value")).write.text(path)


def write_checkpoint(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of a run as Parquet, one folder each, to start again from."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_checkpoint(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_summary(sections: list[tuple[str, str, DataFrame | None]], path: str, title: str = "", most: int = 50) -> None:
    """One HTML page of (heading, text, table or none), the first ``most`` rows of each table. The page is
    written by Spark as one text file, so it goes wherever its tables go."""
    from html import escape

    spark = next(df.sparkSession for _, _, df in sections if df is not None)
    out = [f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for head, text, df in sections:
        out.append(f"<h2>{escape(head)}</h2><p>{escape(text)}</p>")
        if df is not None:
            rows = df.limit(most).collect()
            cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in row) + "</tr>"
            out.append("<table>" + cells("th", df.columns) + "".join(cells("td", r) for r in rows) + "</table>")
    out.append("</body></html>")
    spark.createDataFrame([("\n".join(out),)], "value string").coalesce(1).write.text(path)
