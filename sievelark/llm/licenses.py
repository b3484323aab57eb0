"""License scans: TF-IDF cosine of passages to templates, and inheritance from the nearest licensed directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelark.llm.common import documents, store
from sievelark.llm.registry import query

# Fixed values, also in the SQL: one-line notices by SPDX identifier, five as in the test documents; whole texts and SPDX headers are missing.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
#: A line that may name a license.
CUE = r"(?i)licen[sc]e|copyright|rights reserved|public domain|spdx"
#: Cosine from which a line names a license, and from which a whole text is a license file.
HEADER, FILE = 0.6, 0.25
#: Directories with a license of their own are broadcast up to so many.
FEW_DIRS = 200_000


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def cosines(passages: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``pid, license, cosine`` of the best template per passage (``pid, passage``).

    Weights are term counts times ln((1 + N) / (1 + passages with the term)) + 1; terms meet
    templates in a join on the term, so only shared terms cost anything. Ties go to the
    license that comes first by name.
    """
    spark = passages.sparkSession
    tf = store(passages.select("pid", F.explode(_terms(F.col("passage"))).alias("term")).groupBy("pid", "term").agg(F.count(F.lit(1)).alias("tf")), "license-terms")
    n = passages.count()
    known = spark.createDataFrame(list(templates.items()), "license string, notice string").select("license", F.explode(_terms(F.col("notice"))).alias("term"))
    known = known.groupBy("license", "term").agg(F.count(F.lit(1)).alias("ttf"))
    idf = tf.groupBy("term").agg((F.log((F.lit(1.0) + n) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    rare = F.log(F.lit(1.0) + n) + 1.0
    weighted = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known = known.join(idf, "term", "left").withColumn("tw", F.col("ttf") * F.coalesce("idf", rare))
    tnorm = known.groupBy("license").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    dots = weighted.join(F.broadcast(known.select("license", "term", "tw")), "term").groupBy("pid", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))  # templates are fixed
    cos = dots.join(norm, "pid").join(F.broadcast(tnorm), "license").select("pid", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("cosine"))
    best = cos.groupBy("pid").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("license"))).alias("b"))
    return best.select("pid", "b.license", (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``path, license, cosine, evidence, origin`` per distinct path of ``files`` (``path, text``).

    ``evidence`` is "header" (a line of the text names a license), "file" (the whole text is
    a license), "inherited" (from the nearest directory above that holds a license file,
    which is ``origin``) or null. Equal passages are compared once. A directory with several
    license files takes the one with the best cosine, then the first path. Null and empty
    texts name nothing; null paths are one path without directories; rows that repeat a path
    pool their passages.
    """
    cued = files.where(F.col("text").rlike(CUE)).select("path", "text")
    links = cued.select("path", F.explode(F.concat(
        F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE)), lambda x: F.struct(F.lit("header").alias("kind"), x.alias("passage"))),
        F.array(F.struct(F.lit("file").alias("kind"), F.col("text").alias("passage"))))).alias("x")).select("path", "x.kind", F.md5(F.col("x.passage").cast("binary")).alias("pid"), "x.passage")
    passages = store(links.groupBy("pid").agg(F.first("passage").alias("passage")), "license-passages")
    best = cosines(passages, templates)
    hit = links.select("path", "kind", "pid").join(best, "pid").where(((F.col("kind") == "header") & (F.col("cosine") >= HEADER)) | ((F.col("kind") == "file") & (F.col("cosine") >= FILE)))
    own = hit.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("license"), F.col("kind").alias("kind"))).alias("b"), F.max(F.struct(F.col("kind") == "file", F.when(F.col("kind") == "file", F.col("cosine")), F.when(F.col("kind") == "file", F.col("license")))).alias("f"))
    own = store(own.select("path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), F.col("b.kind").alias("evidence"), F.col("f.col1").alias("is_file"), F.col("f.col2").alias("fcos"), F.col("f.col3").alias("flic")), "license-own")
    up = F.regexp_replace("path", "/?[^/]*$", "")
    rooted = own.where("is_file AND path IS NOT NULL").select(up.alias("dir"), F.struct((-F.col("fcos")).alias("c"), F.col("path").alias("path"), F.col("flic").alias("license")).alias("s"))
    rooted = store(rooted.groupBy("dir").agg(F.min("s").alias("s")).select("dir", F.col("s.license").alias("dlicense"), (-F.col("s.c")).alias("dcosine")), "license-dirs")
    paths = files.select("path").distinct()
    plain = paths.join(own.select("path", "license", "cosine", "evidence"), paths["path"].eqNullSafe(own["path"]), "left").drop(own["path"])
    plain = plain.withColumn("dir", F.when(F.col("path").isNotNull(), up))
    # a directory and those above it, nearest first: its parts, and ever fewer of them
    parts = F.split("dir", "/")
    above = plain.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up", "anc"))
    few = F.broadcast(rooted) if rooted.count() <= FEW_DIRS else rooted
    near = above.join(few, F.col("anc") == few["dir"]).select(above["dir"], F.struct("up", F.col("anc"), "dlicense", "dcosine").alias("s")).groupBy("dir").agg(F.min("s").alias("s"))
    near = near.select(F.col("dir").alias("_dir"), F.col("s.anc").alias("anc"), F.col("s.dlicense").alias("dlicense"), F.col("s.dcosine").alias("dcosine"))
    out = plain.join(near, F.col("dir") == F.col("_dir"), "left")
    got = F.col("license").isNotNull()
    return out.select("path", F.coalesce("license", "dlicense").alias("license"), F.when(got, F.col("cosine")).otherwise(F.col("dcosine")).alias("cosine"),
                      F.when(got, F.col("evidence")).when(F.col("dlicense").isNotNull(), "inherited").alias("evidence"), F.when(~got, F.col("anc")).alias("origin"))


_T = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())


@query("op5_license_tfidf", rf"""
WITH d AS (SELECT doc_id, text, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path FROM documents),
links AS (SELECT path, 'file' AS kind, text AS passage FROM d WHERE regexp_matches(text, '{CUE}')
  UNION ALL SELECT path, 'header', line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{CUE}')),
p AS (SELECT DISTINCT passage FROM links), n AS (SELECT count(*) AS n FROM p),
tf AS (SELECT passage, term, count(*) AS tf FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM p) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1.0 AS idf FROM tf, n GROUP BY term),
k AS (SELECT license, term, count(*) AS ttf FROM (SELECT license, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS term FROM (VALUES {_T}) v(license, notice)) GROUP BY ALL),
kw AS (SELECT license, term, ttf * coalesce(idf, ln(1.0::DOUBLE + n) + 1.0) AS tw FROM k LEFT JOIN idf USING (term), n),
w AS (SELECT passage, term, tf * idf AS w FROM tf JOIN idf USING (term)),
cos AS (SELECT w.passage, kw.license, round(sum(w.w * kw.tw) / (any_value(a.norm) * any_value(b.norm)), 6) AS cosine FROM w JOIN kw USING (term)
  JOIN (SELECT passage, sqrt(sum(w * w)) AS norm FROM w GROUP BY passage) a ON a.passage = w.passage JOIN (SELECT license, sqrt(sum(tw * tw)) AS norm FROM kw GROUP BY license) b ON b.license = kw.license GROUP BY w.passage, kw.license),
best AS (SELECT passage, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY cosine DESC, license) AS r FROM cos) WHERE r = 1),
hit AS (SELECT path, kind, license, cosine FROM links JOIN best USING (passage) WHERE (kind = 'header' AND cosine >= {HEADER}) OR (kind = 'file' AND cosine >= {FILE})),
own AS (SELECT path, license, cosine, kind AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license, kind) AS r FROM hit) WHERE r = 1),
dirs AS (SELECT dir, license, cosine FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, cosine, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cosine DESC, path) AS r FROM hit WHERE kind = 'file') WHERE r = 1),
inh AS (SELECT path, license, cosine, dir FROM (SELECT d.path, dirs.*, row_number() OVER (PARTITION BY d.path ORDER BY len(dirs.dir) DESC) AS r FROM d JOIN dirs ON starts_with(d.path, dirs.dir || '/')) WHERE r = 1)
SELECT d.doc_id, coalesce(own.license, inh.license) AS license, CASE WHEN own.license IS NOT NULL THEN own.cosine ELSE inh.cosine END AS cosine,
  CASE WHEN own.license IS NOT NULL THEN own.evidence WHEN inh.license IS NOT NULL THEN 'inherited' END AS evidence, CASE WHEN own.license IS NULL THEN inh.dir END AS origin
FROM d LEFT JOIN own USING (path) LEFT JOIN inh USING (path)""")
def _(spark, base):
    docs = documents(spark, base)
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), "text")
    found = scan(files.select("path", "text"))
    return files.select("doc_id", "path").join(found, "path", "left").select("doc_id", "license", "cosine", "evidence", "origin")
