"""Queries of the llm operators and, where it can be written, their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import annindex, communities, leaks, looks, mixing, overlap, proportions
from chronoloom.plans.cleaning import CELLS_SQL
from chronoloom.storage import table


def _index(spark: SparkSession, d: str) -> annindex.Index:
    return annindex.Index(annindex.usable_vectors(table(spark, d, "ctrans"), table(spark, d, "hyper_parameters")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return annindex.neighbour_pairs(annindex.neighbours(table(spark, d, "ctrans"), table(spark, d, "hyper_parameters")))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against brute force, for the samples whose id is divisible by 20."""
    index = _index(spark, d)
    return annindex.measured_recall(index, annindex.index_neighbours(index, index.calibrate()))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return communities.Clusters(table(spark, d, "ctrans"), table(spark, d, "hyper_parameters")).found()


def p3_described(spark: SparkSession, d: str) -> DataFrame:
    return communities.Clusters(table(spark, d, "ctrans"), table(spark, d, "hyper_parameters")).described()


def p3_quality(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the communities and recall of the graph, per dataset."""
    return communities.Clusters(table(spark, d, "ctrans"), table(spark, d, "hyper_parameters")).quality()


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, d, "samples"), table(spark, d, "channels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "test_id").alias("sample_a"), F.greatest("train_id", "test_id").alias("sample_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "samples"), _overlaps(spark, d))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against comparing each with each, for stated and for disturbed records."""
    return overlap.measured_recall(table(spark, d, "samples"), table(spark, d, "channels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Also paraphrases, with the longest run of words, the common subsequence and the share of the answer."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), paraphrases=True)


def p8_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many items are found whose copies among the documents have every 8th word replaced."""
    return leaks.paraphrase_recall(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    out = proportions.draw_report(table(spark, d, "samples"), table(spark, d, "label_targets"))
    return out.select("plan_id", "label", "wanted", "usable", "available", "quota", "drawn", "actual_share", "short", "failed")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_report(spark, d).filter("failed").select("plan_id", "label")


def p7_drawn(spark: SparkSession, d: str) -> DataFrame:
    return proportions.draw(table(spark, d, "samples"), table(spark, d, "label_targets"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(mixing.document_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().filter("shortfall > 0").select("mix_id", "source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().drop("repeats")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def p9_tokenized(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The report with sizes in tokens of a public tokenizer."""
    return mixing.Mix(mixing.sizes_by_vocabulary(table(spark, d, "documents"), vocabulary), table(spark, d, "mix_targets")).report()


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).records()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_alikes(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_classes(table(spark, d, "documents"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the form of its text."""
    return looks.canonical_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "canonical", F.coalesce(F.col("canonical") != F.col("text"), F.lit(False)).alias("changed"))


QUERIES = {f.__name__: f for f in (p1_found, p1_recall, p3_found, p3_described, p3_quality, p5_found, p5_report, p5_recall, p7_found, p7_report, p7_drawn, p8_found, p8_leaks, p8_recall, p9_found, p9_report, p9_tokenized, p9_mixed, p10_found, p10_classes, p10_canonical)}

USABLE_SQL = """
usable AS (SELECT DISTINCT ON (c.sample_id) c.sample_id, c.dataset, c.c_trans AS v, h.k_nearest, h.k_dis_high, h.eps, h.min_samples
           FROM ctrans c JOIN hyper_parameters h USING (dataset)
           WHERE c.c_trans IS NOT NULL AND len(c.c_trans) = h.emb_len AND len(list_filter(c.c_trans, lambda x: x IS NULL OR isnan(x))) = 0
           ORDER BY c.sample_id, c.computed_at DESC),
dist AS (SELECT a.sample_id AS a, b.sample_id AS b, a.k_nearest, a.k_dis_high, a.eps, a.min_samples,
                list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS d
         FROM usable a JOIN usable b ON a.dataset = b.dataset AND a.sample_id <> b.sample_id)"""

# The same shapes once more, written for SQL by code point, independent of the operator's own table.
SHAPES = {
    "A": "0410 0391", "B": "0412 0392", "C": "0421 03F9", "E": "0415 0395", "G": "050C", "H": "041D 0397", "I": "0406 0399 04C0", "J": "0408 037F", "K": "041A 039A", "M": "041C 039C", "N": "039D",
    "O": "041E 039F", "P": "0420 03A1", "Q": "051A", "S": "0405", "T": "0422 03A4", "V": "0474", "W": "051C", "X": "0425 03A7", "Y": "0423 03A5 04AE", "Z": "0396",
    "a": "0430", "c": "0441 03F2", "d": "0501", "e": "0435", "h": "04BB", "i": "0456", "j": "0458 03F3", "l": "04CF", "o": "043E 03BF", "p": "0440", "q": "051B", "s": "0455", "v": "0475 03BD", "w": "051D",
    "x": "0445", "y": "0443 04AF", "Æ": "04D4", "æ": "04D5", "Ə": "04D8", "ə": "04D9", "μ": "00B5", "-": "2010 2011 058A 1806 FE63",
}
FOREIGN = "".join(chr(int(x, 16)) for codes in SHAPES.values() for x in codes.split())
LATIN = "".join(shape * len(codes.split()) for shape, codes in SHAPES.items())
#: Composed letters on such a shape, by the rule of their decomposition.
COMPOSED = {chr(i): unicodedata.normalize("NFC", LATIN[FOREIGN.index(p[0])] + p[1:]) for i in range(0x370, 0x500) if len(p := unicodedata.normalize("NFD", chr(i))) > 1 and p[0] in FOREIGN}
COMPOSED = {k: v for k, v in COMPOSED.items() if len(v) == 1}
FOREIGN, LATIN = FOREIGN + "".join(COMPOSED), LATIN + "".join(COMPOSED.values())


def _look_sql(c: str) -> str:
    """The form of problem 10 in SQL."""
    wide, ascii_ = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
    return rf"nfc_normalize(regexp_replace(regexp_replace(translate({c}, '{FOREIGN}{wide}', '{LATIN}{ascii_}'), '\p{{Cf}}', '', 'g'), '\p{{Zs}}', ' ', 'g'))"


ORACLE = {
    "p1_found": f"""WITH {USABLE_SQL},
near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM dist)
SELECT DISTINCT least(a, b) AS sample_a, greatest(a, b) AS sample_b FROM near WHERE r <= k_nearest AND d <= k_dis_high""",
    "p3_found": f"""WITH RECURSIVE {USABLE_SQL},
link AS MATERIALIZED (SELECT a, b FROM dist WHERE d <= eps),
reach AS (SELECT sample_id AS a, sample_id AS m FROM usable UNION SELECT l.b, r.m FROM reach r JOIN link l ON l.a = r.a WHERE r.m < l.b),
least_of AS (SELECT a AS sample_id, min(m) AS cluster_min_id FROM reach GROUP BY a),
sized AS (SELECT l.*, u.min_samples, count(*) OVER (PARTITION BY cluster_min_id) AS n FROM least_of l JOIN usable u USING (sample_id))
SELECT sample_id, cluster_min_id FROM sized WHERE n >= min_samples""",
    "p5_found": f"""WITH {CELLS_SQL},
here AS (SELECT * FROM read WHERE val IS NOT NULL),
m AS (SELECT sample_id, var_id, median(val) AS m FROM here GROUP BY ALL),
dev AS (SELECT r.*, abs(val - m.m) AS dv FROM here r JOIN m USING (sample_id, var_id)),
s AS (SELECT sample_id, var_id, 1.4826 * median(dv) AS s FROM dev GROUP BY ALL),
flag AS (SELECT d.*, d.dv > 8 * s.s AS far, row_number() OVER w AS n, lag(val) OVER w AS before FROM dev d JOIN s USING (sample_id, var_id)
         WINDOW w AS (PARTITION BY sample_id, var_id ORDER BY pos)),
runs AS (SELECT *, sum(CASE WHEN before = val THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id, var_id ORDER BY n) AS same,
                n - row_number() OVER (PARTITION BY sample_id, var_id, far ORDER BY n) AS stretch FROM flag),
lens AS (SELECT *, count(*) OVER (PARTITION BY sample_id, var_id, same) AS equal_len, count(*) OVER (PARTITION BY sample_id, var_id, far, stretch) AS far_len FROM runs),
good AS (SELECT l.sample_id, l.dataset, l.var_id, l.pos, l.val, split FROM lens l JOIN (SELECT DISTINCT sample_id, split FROM samples) USING (sample_id)
         WHERE NOT coalesce(val < phys_lo OR val > phys_hi, false) AND NOT (far AND far_len <= 3) AND equal_len < 8),
sd AS (SELECT sample_id, var_id, stddev_pop(val) AS sd FROM good WHERE split = 'test' GROUP BY ALL),
per AS (SELECT a.sample_id AS tr, b.sample_id AS te, h, a.var_id, count(*) AS n, count(*) FILTER (abs(a.val - b.val) <= 0.05 * sd) AS ok
        FROM good b JOIN sd ON sd.sample_id = b.sample_id AND sd.var_id = b.var_id, range(-3, 4) r(h), good a
        WHERE b.split = 'test' AND a.split = 'train' AND a.dataset = b.dataset AND a.var_id = b.var_id AND a.pos = b.pos + h GROUP BY ALL)
SELECT DISTINCT least(tr, te) AS sample_a, greatest(tr, te) AS sample_b FROM
  (SELECT tr, te, h FROM per WHERE n >= 5 GROUP BY ALL HAVING bool_and(ok >= 0.9 * n))""",
    "p7_found": """WITH u AS (SELECT DISTINCT sample_id, dataset, label FROM samples WHERE label IS NOT NULL),
per AS (SELECT dataset, label, count(*) AS n FROM u GROUP BY ALL), tot AS (SELECT dataset, count(*) AS t FROM u GROUP BY ALL)
SELECT plan_id, label FROM label_targets l LEFT JOIN per USING (dataset, label) LEFT JOIN tot USING (dataset)
WHERE coalesce(n, 0) < target_share * sample_frac * coalesce(t, 0) OR coalesce(n, 0) < min_rows""",
    "p7_report": """WITH u AS (SELECT DISTINCT sample_id, dataset, label FROM samples WHERE label IS NOT NULL),
per AS (SELECT dataset, label, count(*) AS n FROM u GROUP BY ALL), tot AS (SELECT dataset, count(*) AS t FROM u GROUP BY ALL),
q AS (SELECT plan_id, label, min_rows, target_share * sample_frac * coalesce(t, 0) AS wanted, coalesce(t, 0) AS usable, coalesce(n, 0) AS available FROM label_targets LEFT JOIN per USING (dataset, label) LEFT JOIN tot USING (dataset)),
d AS (SELECT *, least(available, greatest(ceil(wanted)::BIGINT, CASE WHEN usable > 0 THEN min_rows ELSE 0 END))::BIGINT AS quota FROM q)
SELECT plan_id, label, wanted, usable, available, quota, quota AS drawn, CASE WHEN sum(quota) OVER (PARTITION BY plan_id) > 0 THEN quota / sum(quota) OVER (PARTITION BY plan_id) END AS actual_share,
greatest(wanted - quota, min_rows - quota, 0.0)::DOUBLE AS short, quota < wanted OR quota < min_rows AS failed FROM d""",
    "p9_found": r"""WITH s AS (SELECT lower(trim(source)) AS k, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\v\f\r\x1c-\x20\x{85}\p{Z}]+')) AS n FROM documents WHERE source IS NOT NULL),
per AS (SELECT k, sum(n) AS size FROM s GROUP BY k), tot AS (SELECT sum(n) AS t FROM s)
SELECT mix_id, source FROM mix_targets m LEFT JOIN per ON per.k = lower(trim(m.source)), tot
WHERE weight * budget_share * t > max_repeats * coalesce(size, 0)""",
    "p9_report": r"""WITH s AS (SELECT lower(trim(source)) AS k, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\v\f\r\x1c-\x20\x{85}\p{Z}]+')) AS n FROM documents WHERE source IS NOT NULL),
per AS (SELECT k, sum(n) AS size FROM s GROUP BY k), tot AS (SELECT sum(n)::BIGINT AS total FROM s),
p AS (SELECT mix_id, source, weight, max_repeats, total, coalesce(size, 0)::BIGINT AS size, weight * budget_share * total AS target, (max_repeats * coalesce(size, 0))::BIGINT AS capacity FROM mix_targets m LEFT JOIN per ON per.k = lower(trim(m.source)), tot),
d AS (SELECT *, least(ceil(target), capacity)::BIGINT AS drawn FROM p)
SELECT mix_id, source, weight, max_repeats, total, size, target, capacity, drawn, drawn / sum(drawn) OVER (PARTITION BY mix_id) AS actual_share, greatest(target - drawn, 0) AS shortfall, drawn < target AS failed FROM d""",
    "p8_found": rf"""WITH t AS (SELECT doc_id, NULL::BIGINT AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM eval_items),
w AS (SELECT doc_id, item_id, regexp_extract_all(lower({_look_sql('text')}), '[\p{{L}}\p{{N}}]+') AS w FROM t WHERE text IS NOT NULL),
g AS (SELECT doc_id, item_id, unnest([array_to_string(w[i : i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM w WHERE len(w) >= 13)
SELECT DISTINCT a.doc_id, b.item_id FROM g a JOIN g b ON a.g = b.g AND a.doc_id IS NOT NULL AND b.item_id IS NOT NULL""",
    "p10_found": f"""WITH c AS (SELECT doc_id, text, {_look_sql('text')} AS k FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM c a JOIN c b ON a.k = b.k AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.k, '\\S')""",
}

ORACLE["p5_report"] = f"""WITH pairs AS ({ORACLE["p5_found"]}),
once AS (SELECT DISTINCT ON (sample_id) sample_id, dataset, split FROM samples WHERE sample_id IS NOT NULL AND split IN ('train', 'test') ORDER BY sample_id, dataset, split),
hit AS (SELECT sample_id, count(*) AS n FROM (SELECT sample_a AS sample_id FROM pairs UNION ALL SELECT sample_b FROM pairs) GROUP BY 1)
SELECT dataset, split, count(*) AS n_samples, count(n) AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs FROM once LEFT JOIN hit USING (sample_id) GROUP BY ALL"""
ORACLE["p10_classes"] = f"""WITH c AS (SELECT doc_id, text, {_look_sql('text')} AS k FROM documents WHERE text IS NOT NULL),
g AS (SELECT k, min(doc_id) AS class_id, count(DISTINCT text) AS kinds FROM c WHERE regexp_matches(k, '\\S') GROUP BY k HAVING count(DISTINCT text) > 1)
SELECT doc_id, class_id, kinds FROM c JOIN g USING (k)"""
ORACLE["p10_canonical"] = f"SELECT doc_id, {_look_sql('text')} AS canonical, coalesce({_look_sql('text')} <> text, false) AS changed FROM documents"
