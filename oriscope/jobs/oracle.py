"""The registered queries as DuckDB SQL, written independently of the Spark jobs: named parts, joined as needed."""

from __future__ import annotations

import re

from oriscope.functions.numeric import Z95, Z975
from oriscope.jobs import projection as p

#: Steps of inference and rounds of factorisation, enough for the digits that are compared.
STEPS, ROUNDS = 150, 400

MAPPED_ASSIGNED = """SELECT sample_id, read_id, genome_id, ref_name, ref_length, pos FROM uniq UNION ALL
    SELECT b.sample_id, b.read_id, b.genome_id, b.ref_name, b.ref_length, b.pos FROM best b JOIN multi m USING (sample_id, read_id) JOIN chosen c USING (sample_id, genomes)
    WHERE NOT discarded AND b.genome_id = c.chosen"""

PARTS = {
    "aln": f"""
        SELECT *, split_part(ref_name, '|', 1) AS genome_id FROM (
        SELECT 'S' || (l_orderkey % 4) AS sample_id, l_orderkey AS read_id, l_linenumber AS line,
            CASE WHEN l_tax > CAST(0.075 AS DOUBLE) THEN 4 ELSE 0 END + CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 128 ELSE 0 END AS flag,
            'G' || g || '|' || CASE WHEN g < 5 THEN 'c0' ELSE 'c' || (l_partkey % 3) END AS ref_name, len AS ref_length,
            ((1000000 + (g * 90001) % 1000000 + CASE WHEN l_linenumber % 2 = 0 THEN d ELSE -d END) % 1000000) % len AS pos,
            CAST(-3 * round(l_discount * 100) AS INTEGER) AS as_score, CAST(40 + l_quantity AS INTEGER) AS query_length
        FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN least(h1, h2) ELSE h1 END AS d FROM (
            SELECT *, l_suppkey % 10 AS g, CAST(CASE WHEN l_suppkey % 10 < 5 THEN 1000000 ELSE 400000 END AS BIGINT) AS len,
                (l_orderkey * 1000003 + l_partkey * 7919 + l_linenumber * 104729) % 499979 AS h1,
                (l_orderkey * 15485863 + l_partkey * 32452843 + l_linenumber * 49979687) % 499979 AS h2 FROM lineitem)))""",
    "header": "SELECT DISTINCT sample_id, genome_id, ref_name, ref_length AS length FROM aln",
    "kind": "SELECT sample_id, genome_id, count(*) > 1 AS is_assembly FROM header GROUP BY 1, 2",
    "passed": "SELECT * FROM aln WHERE flag & 644 = 0 AND 10 * as_score >= -3 * query_length",
    "best": """SELECT *, count(*) OVER (PARTITION BY sample_id, read_id) AS n_hits FROM (
        SELECT *, rank() OVER (PARTITION BY sample_id, read_id ORDER BY as_score DESC) AS r FROM passed) WHERE r = 1""",
    "uniq": "SELECT * FROM best WHERE n_hits = 1",
    # The reads that coverage is made of; MAPPED_ASSIGNED takes its place in the whole job.
    "mapped": "SELECT sample_id, read_id, genome_id, ref_name, ref_length, pos FROM uniq",
    "multi": """SELECT sample_id, read_id, string_agg(DISTINCT genome_id, ',' ORDER BY genome_id) AS genomes, count(*) AS n_hits,
        count(DISTINCT genome_id) < count(*) OR count(*) >= 10 AS discarded FROM best WHERE n_hits > 1 GROUP BY 1, 2""",
    "classes": "SELECT sample_id, genomes, count(*) AS reads FROM multi WHERE NOT discarded GROUP BY 1, 2",
    "priors": """SELECT c.sample_id, c.genome_id, CASE WHEN c.fraction > CAST(0.3 AS DOUBLE) THEN coalesce(u.n, 0) ELSE 0 END AS prior FROM cov c
        LEFT JOIN (SELECT sample_id, genome_id, count(*) AS n FROM uniq GROUP BY 1, 2) u USING (sample_id, genome_id)""",
    "cov": """SELECT t.sample_id, t.genome_id, coalesce(c.covered, 0) AS covered, t.total, coalesce(c.covered, 0) / t.total AS fraction FROM
        (SELECT sample_id, genome_id, CAST(sum(ceil(l / 5000)) AS BIGINT) AS total FROM
            (SELECT sample_id, genome_id, ref_name, max(ref_length) AS l FROM best GROUP BY ALL) GROUP BY ALL) t
        LEFT JOIN (SELECT sample_id, genome_id, count(DISTINCT ref_name || ':' || (pos // 5000)) AS covered FROM uniq GROUP BY ALL) c USING (sample_id, genome_id)""",
    "complete": f"""SELECT u.*, {p.BINS} AS nb0, (ref_length // {p.BINS}) - (ref_length // {p.BINS}) % 100 AS b, ref_length AS full_length
        FROM mapped u JOIN kind k USING (sample_id, genome_id) WHERE NOT k.is_assembly""",
    "hist": """SELECT g.sample_id, g.genome_id, g.bin_ix, count(r.pos) AS cnt FROM
        (SELECT sample_id, genome_id, unnest(range(CAST(ceil(max(ref_length) / max(b)) AS BIGINT))) AS bin_ix FROM complete GROUP BY 1, 2) g
        LEFT JOIN (SELECT *, CAST(floor(ceil(ref_length / b) * pos / ref_length) AS BIGINT) AS bin_ix FROM complete) r USING (sample_id, genome_id, bin_ix)
        GROUP BY ALL""",
    "reg1": "SELECT sample_id, genome_id, l AS \"left\", r AS \"right\" FROM reg1_",
    "reg2": "SELECT sample_id, genome_id, l AS \"left\", r AS \"right\" FROM reg2_",
    "pairs": """SELECT sample_id, genome_id, raw, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(covered, 0) AS covered,
        1 - (len - coalesce(g1, 0)) / len AS cut1, 1 - (len - coalesce(g1, 0) - coalesce(g2, 0)) / len AS cut2 FROM
        (SELECT sample_id, genome_id, count(*) AS raw, max(ref_length) AS len FROM complete GROUP BY 1, 2)
        LEFT JOIN (SELECT sample_id, genome_id, count(*) AS n1 FROM phase1 GROUP BY 1, 2) USING (sample_id, genome_id)
        LEFT JOIN (SELECT sample_id, genome_id, CAST(sum(r - l) AS BIGINT) AS g1 FROM reg1_ GROUP BY 1, 2) USING (sample_id, genome_id)
        LEFT JOIN (SELECT sample_id, genome_id, CAST(sum(r - l) AS BIGINT) AS g2 FROM reg2_ GROUP BY 1, 2) USING (sample_id, genome_id)
        LEFT JOIN (SELECT sample_id, genome_id, count(*) AS n2, count(DISTINCT floor(nb * pos / ref_length)) / greatest(1, max(nb)) AS covered
            FROM (SELECT *, ceil(ref_length / b) AS nb FROM phase2) GROUP BY 1, 2) USING (sample_id, genome_id)""",
    "kept": f"SELECT p.* FROM phase2 p JOIN pairs USING (sample_id, genome_id) WHERE raw >= {p.MIN_READS} AND cut1 <= 0.25",
    "pass": "SELECT k.* FROM kept k JOIN qc USING (sample_id, genome_id) WHERE passed_qc",
    "csizes": f"""SELECT *, length // bin_size AS n_bins FROM (SELECT *, greatest(1000, total // {p.CONTIG_BINS}) - greatest(1000, total // {p.CONTIG_BINS}) % 100 AS bin_size FROM (
        SELECT h.*, CAST(sum(length) OVER (PARTITION BY sample_id, genome_id) AS BIGINT) AS total FROM header h JOIN kind USING (sample_id, genome_id) WHERE is_assembly AND length >= 11000))""",
    "chist": """SELECT g.sample_id, g.genome_id, g.ref_name, g.bin_ix, count(r.pos) AS cnt FROM
        (SELECT sample_id, genome_id, ref_name, unnest(range(n_bins)) AS bin_ix FROM csizes) g
        LEFT JOIN (SELECT u.*, CAST(floor(n_bins * pos / length) AS BIGINT) AS bin_ix FROM mapped u JOIN csizes USING (sample_id, genome_id, ref_name)) r
        USING (sample_id, genome_id, ref_name, bin_ix) GROUP BY ALL""",
    "cqc": """SELECT *, 1 - zero_bins / total_bins AS frac_nonzero, zero_bins <= 0.5 * total_bins AND total_bins >= 50 AS passed_qc FROM (
        SELECT sample_id, genome_id, count(*) AS total_bins, count(*) FILTER (cnt = 0) AS zero_bins, CAST(sum(cnt) AS BIGINT) AS n_reads FROM chist GROUP BY 1, 2)""",
    "matrix": """SELECT genome_id, sample_id, row_number() OVER (PARTITION BY sample_id, genome_id ORDER BY ref_name, bin_ix) - 1 AS bin_ix, cnt
        FROM chist JOIN cqc USING (sample_id, genome_id) WHERE passed_qc""",
    "masked": f"""SELECT genome_id, sample_id, bin_ix, CASE WHEN cnt BETWEEN pow(2, m - {Z95}::DOUBLE * s) AND pow(2, m + {Z95}::DOUBLE * s) THEN cnt END AS cnt FROM matrix JOIN (
        SELECT genome_id, sample_id, log2(median(cnt)) AS m, greatest(1.0, stddev_pop(log2(cnt))) AS s FROM matrix WHERE cnt > 0 GROUP BY 1, 2) USING (genome_id, sample_id)""",
    "sgate": f"""SELECT *, reads > {p.MIN_READS} AND frac_masked < 0.25 AS kept FROM (SELECT genome_id, sample_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS reads,
        count(*) FILTER (cnt IS NULL) / count(*) AS frac_masked FROM masked GROUP BY 1, 2)""",
    "msgate": f"SELECT genome_id, sample_id FROM sgate WHERE kept QUALIFY count(*) OVER (PARTITION BY genome_id) >= {p.MIN_SAMPLES}",
    "kbins": """SELECT genome_id, bin_ix FROM (SELECT genome_id, bin_ix, count(*) FILTER (cnt IS NULL) AS m, count(*) AS n FROM masked JOIN msgate USING (genome_id, sample_id) GROUP BY 1, 2)
        WHERE m < 0.025 * n""",
    "kcells": "SELECT genome_id, sample_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS reads, avg(CASE WHEN cnt > 0 THEN 1.0 WHEN cnt = 0 THEN 0.0 END) AS covered FROM masked JOIN msgate USING (genome_id, sample_id) JOIN kbins USING (genome_id, bin_ix) GROUP BY 1, 2",
    "bgate": f"SELECT genome_id, bin_ix FROM kbins QUALIFY count(*) OVER (PARTITION BY genome_id) >= {p.MIN_SAMPLES}",
    "gcells": "SELECT genome_id, sample_id, bin_ix, CAST(cnt AS DOUBLE) AS x FROM masked JOIN msgate USING (genome_id, sample_id) JOIN bgate USING (genome_id, bin_ix) WHERE cnt IS NOT NULL",
    # Newton steps for the bins' and the samples' factors in turn.
    "factors": f"""SELECT genome_id, sample_id, bin_ix, x, CAST(1 AS DOUBLE) AS w, ln(avg(x) OVER (PARTITION BY genome_id, sample_id) + 0.1) AS v, 0 AS i FROM gcells UNION ALL
        SELECT genome_id, sample_id, bin_ix, x, w, v + greatest(-0.5, least(0.5, sum(w * (x - exp(w * v))) OVER y / sum(w * w * exp(w * v)) OVER y)), i + 1 FROM (
        SELECT genome_id, sample_id, bin_ix, x, v, i, w + greatest(-0.5, least(0.5, sum(v * (x - exp(w * v))) OVER z / sum(v * v * exp(w * v)) OVER z)) AS w
        FROM factors WHERE i < {ROUNDS} WINDOW z AS (PARTITION BY genome_id, bin_ix)) WINDOW y AS (PARTITION BY genome_id, sample_id)""",
    "binorder": f"""SELECT genome_id, bin_ix, w, row_number() OVER (PARTITION BY genome_id ORDER BY round(w, 7), bin_ix) AS place FROM (
        SELECT genome_id, bin_ix, w / sqrt(avg(w * w) OVER (PARTITION BY genome_id)) AS w FROM (SELECT genome_id, bin_ix, max(w) AS w FROM factors WHERE i = {ROUNDS} GROUP BY 1, 2))""",
    "trim": """SELECT genome_id, sample_id, nth - lo AS ix, cnt FROM (
        SELECT *, CAST(floor(CAST(0.05 AS DOUBLE) * n) AS BIGINT) AS lo, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT) AS hi FROM (
        SELECT genome_id, sample_id, cnt, row_number() OVER (PARTITION BY genome_id, sample_id ORDER BY place) - 1 AS nth, count(*) OVER (PARTITION BY genome_id, sample_id) AS n
        FROM masked JOIN msgate USING (genome_id, sample_id) JOIN binorder USING (genome_id, bin_ix) WHERE cnt IS NOT NULL)) WHERE nth >= lo AND nth < hi""",
    "lists": """SELECT genome_id, sample_id, list(CAST(cnt AS DOUBLE) ORDER BY ix) AS c, count(*) AS n, avg(CASE WHEN cnt > 0 THEN 1.0 ELSE 0.0 END) AS cov_frac,
        sum(cnt * ix) / sum(cnt) / (count(*) - 1) AS mean FROM trim GROUP BY 1, 2""",
    "slope": """SELECT genome_id, sample_id, n, mean, 0 AS i, CAST(-64 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi FROM lists UNION ALL
        SELECT genome_id, sample_id, n, mean, i + 1, CASE WHEN e < mean THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e < mean THEN hi ELSE (lo + hi) / 2 END FROM (
        SELECT *, list_sum(list_transform(range(n), lambda k: pow(2, (lo + hi) / 2 * k / (n - 1) - greatest((lo + hi) / 2, 0)) * k / (n - 1)))
            / list_sum(list_transform(range(n), lambda k: pow(2, (lo + hi) / 2 * k / (n - 1) - greatest((lo + hi) / 2, 0)))) AS e FROM slope WHERE i < 60)""",
    "cfit": """SELECT l.*, (s.lo + s.hi) / 2 AS slope, reads FROM slope s JOIN lists l USING (genome_id, sample_id)
        JOIN (SELECT genome_id, sample_id, CAST(sum(x) AS BIGINT) AS reads FROM gcells GROUP BY 1, 2) USING (genome_id, sample_id) WHERE s.i = 60""",
    "cest": """SELECT q.genome_id, q.sample_id, abs(slope) AS log2_ptr, CASE WHEN NOT passed_qc THEN n_reads WHEN NOT kept THEN g.reads WHEN m.sample_id IS NULL THEN n_reads ELSE coalesce(f.reads, k.reads, 0) END AS reads,
        CASE WHEN NOT passed_qc OR NOT kept OR m.sample_id IS NULL THEN frac_nonzero WHEN f.reads IS NOT NULL THEN cov_frac ELSE covered END AS cov_frac
        FROM cqc q LEFT JOIN sgate g USING (genome_id, sample_id) LEFT JOIN msgate m USING (genome_id, sample_id) LEFT JOIN kcells k USING (genome_id, sample_id) LEFT JOIN cfit f USING (genome_id, sample_id)""",
    "spots": "SELECT sample_id, genome_id, pos, max(ref_length) AS len, count(*) AS c FROM pass GROUP BY 1, 2, 3",
    "med": """SELECT sample_id, genome_id, len AS ref_length, nreads, pos AS ori_pos, cost / (2 * nreads * len) AS mean_distance FROM (
        SELECT a.sample_id, a.genome_id, a.pos, max(a.len) AS len, CAST(sum(b.c) AS BIGINT) AS nreads, CAST(sum(b.c * least(2 * abs(a.pos - b.pos), 2 * a.len - 2 * abs(a.pos - b.pos))) AS BIGINT) AS cost
        FROM spots a JOIN spots b USING (sample_id, genome_id) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY sample_id, genome_id ORDER BY cost, pos) = 1""",
    "fit": "SELECT sample_id, genome_id, (lo + hi) / 2 AS log2_ptr FROM fit_ WHERE i = 60",
    "weighted": "SELECT genome_id, pos / len AS x, log2_ptr * c AS w FROM spots JOIN fit USING (sample_id, genome_id)",
    "shared": """SELECT genome_id, x AS ori, (x + 0.5) % 1 AS ter FROM (
        SELECT genome_id, a.x, round(sum(w * least(abs(a.x - b.x), 1 - abs(a.x - b.x))), 6) AS cost FROM (SELECT DISTINCT genome_id, x FROM weighted) a JOIN weighted b USING (genome_id) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY genome_id ORDER BY cost, x) = 1""",
    "refit": """SELECT sample_id, genome_id, ori, ter, CASE WHEN abs((lo + hi) / 2 - 4) >= 1e-4 THEN (lo + hi) / 2 END AS log2_ptr
        FROM refit_ JOIN shared USING (genome_id) WHERE i = 60""",
    "shared_cost": "SELECT sample_id, genome_id, sum(c * least(abs(pos / len - ori), 1 - abs(pos / len - ori))) / sum(c) AS mean_distance FROM spots JOIN shared USING (genome_id) GROUP BY 1, 2",
    "rest": """SELECT q.sample_id, q.genome_id, CASE WHEN n = 1 THEN CASE WHEN abs(f.log2_ptr - 4) >= 1e-4 THEN f.log2_ptr END ELSE r.log2_ptr END AS log2_ptr,
        CASE WHEN n = 1 THEN own ELSE r.ori END AS ori, CASE WHEN n = 1 THEN (own + 0.5) % 1 ELSE r.ter END AS ter, q.nreads, q.frac_nonzero AS cov_frac
        FROM qc q LEFT JOIN (SELECT sample_id, genome_id, ori_pos / ref_length AS own, count(*) OVER (PARTITION BY genome_id) AS n FROM med) m USING (sample_id, genome_id)
        LEFT JOIN fit f USING (sample_id, genome_id) LEFT JOIN refit r USING (sample_id, genome_id)""",
    "ll": """SELECT sample_id, genome_id, log2_ptr, ori, ter, CASE WHEN log2_ptr > 0 AND log2_ptr <= 4 AND ori <= 1 AND abs(ori - ter) BETWEEN 0.45::DOUBLE AND 0.55::DOUBLE
        THEN sum(c * CASE WHEN ori < ter THEN log2_ptr / (ter - ori) * CASE WHEN x <= ori THEN x - ori WHEN x <= ter THEN ori - x ELSE x - 2 * ter + ori END
            ELSE log2_ptr / (ori - ter) * CASE WHEN x <= ter THEN ter - x WHEN x <= ori THEN x - ter ELSE 2 * ori - ter - x END END) - sum(c) * log2(CASE WHEN ori < ter
            THEN (2 - pow(2, -log2_ptr / (ter - ori) * ori) - 2 * pow(2, -log2_ptr) + pow(2, -log2_ptr / (ter - ori) * (2 * ter - ori - 1))) / (log2_ptr / (ter - ori) * ln(2))
            ELSE (pow(2, log2_ptr / (ori - ter) * ter) + 2 * pow(2, log2_ptr) - 2 - pow(2, log2_ptr / (ori - ter) * (2 * ori - ter - 1))) / (log2_ptr / (ori - ter) * ln(2)) END)
        ELSE CAST('-Infinity' AS DOUBLE) END AS log_lk
        FROM (SELECT sample_id, genome_id, pos / ref_length AS x, 1 AS c FROM complete) r, (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 1.0, 2.0, 4.5]) AS log2_ptr) a,
        (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 0.1, 0.62, 0.3, 1.25]) AS ori, unnest([0.5::DOUBLE, 0.75, 0.0, 0.25, 0.57, 0.15, 0.9, 0.75]) AS ter) b GROUP BY sample_id, genome_id, log2_ptr, ori, ter""",
    "fcells": "SELECT sample_id, genome_id, pos * 200 // len AS cell, sum(c) AS n, sum(c * pos) / max(len) AS s FROM spots GROUP BY 1, 2, 3",
    "borders": """SELECT sample_id, genome_id, k, coalesce(sum(n) FILTER (cell < k), 0) AS w, coalesce(sum(s) FILTER (cell < k), 0.0) AS s, sum(n) AS w_all, sum(s) AS s_all
        FROM fcells, (SELECT unnest(range(200)) AS k) GROUP BY 1, 2, 3""",
    "breaks": """SELECT *, CASE WHEN mean > x1 * x1 / 2 + (x2 - x1) * (x2 - x1) / 2 + (x2 - x1) * (1 - x2) - (1 - x2) * (1 - x2) / 2 THEN 1 ELSE -1 END AS sgn FROM (
        SELECT *, (n1 * x1 - s1 + s2 - s1 - (n2 - n1) * x1 + (2 * x2 - x1) * (n - n2) - (s - s2)) / n AS mean FROM (
        SELECT a.sample_id, a.genome_id, a.k AS i, b.k AS j, a.k / 200 AS x1, b.k / 200 AS x2, a.w AS n1, a.s AS s1, b.w AS n2, b.s AS s2, a.w_all AS n, a.s_all AS s
        FROM borders a JOIN borders b ON a.sample_id = b.sample_id AND a.genome_id = b.genome_id AND b.k BETWEEN a.k + 90 AND a.k + 110))""",
    "free_": """SELECT sample_id, genome_id, i, j, x1, x2, n, mean, sgn, 0 AS step, CAST(1e-6 AS DOUBLE) AS lo, 4 / (x2 - x1) AS hi FROM breaks UNION ALL
        SELECT sample_id, genome_id, i, j, x1, x2, n, mean, sgn, step + 1, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END FROM (
        SELECT *, sgn * ((x1 * pow(2, a * x1) + 2 * (x2 - x1) * pow(2, a * (x2 - x1)) - (2 * x2 - x1 - 1) * pow(2, a * (2 * x2 - x1 - 1)))
            / (pow(2, a * x1) + 2 * pow(2, a * (x2 - x1)) - 2 - pow(2, a * (2 * x2 - x1 - 1))) - 1 / (a * ln(2))) < sgn * mean AS below
        FROM (SELECT *, sgn * (lo + hi) / 2 AS a FROM free_ WHERE step < 50))""",
    "free": """SELECT *, a * n * mean - n * log2((pow(2, a * x1) + 2 * pow(2, a * (x2 - x1)) - 2 - pow(2, a * (2 * x2 - x1 - 1))) / (a * ln(2))) AS log_lk FROM (
        SELECT *, sgn * (lo + hi) / 2 AS a FROM free_ WHERE step = 50)""",
    "ccount": """SELECT sample_id, genome_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS count, count(*) * max(bin_size) AS length FROM masked
        JOIN (SELECT sample_id, genome_id, max(bin_size) AS bin_size FROM csizes GROUP BY 1, 2) USING (sample_id, genome_id) GROUP BY 1, 2""",
    # Counting asks for one read and the coverage only.
    "rcount": "SELECT sample_id, genome_id, count FROM ccount UNION ALL SELECT sample_id, genome_id, nreads FROM qc1 WHERE passed_qc",
    "abun": """SELECT sample_id, genome_id, d / sum(d) OVER (PARTITION BY sample_id) AS rel_abun FROM (
        SELECT sample_id, genome_id, count / length AS d FROM ccount UNION ALL
        SELECT sample_id, genome_id, count(*) / max(ref_length) FROM pass GROUP BY 1, 2)""",
    "ev": """SELECT event_type AS sample_id, 'month' AS genome_id, CAST(2592000 AS BIGINT) AS ref_length, CAST(2592000 AS BIGINT) AS full_length, CAST(51800 AS BIGINT) AS b,
        ((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) % 2592000 + 2592000) % 2592000 AS pos FROM events""",
    "evhist": """SELECT sample_id, genome_id, g.bin_ix, count(r.pos) AS cnt FROM (SELECT DISTINCT sample_id, genome_id, unnest(range(51)) AS bin_ix FROM ev) g
        LEFT JOIN (SELECT *, CAST(floor(51 * pos / ref_length) AS BIGINT) AS bin_ix FROM ev) r USING (sample_id, genome_id, bin_ix) GROUP BY ALL""",
    "evreg": "SELECT sample_id, genome_id, l AS \"left\", r AS \"right\" FROM evreg_",
}


def _bounds(hist: str, z: float) -> str:
    return f"""SELECT sample_id, genome_id, pow(2, m - {z}::DOUBLE * s) AS lower, pow(2, m + {z}::DOUBLE * s) AS upper FROM (
        SELECT sample_id, genome_id, log2(median(cnt)) AS m, greatest(1.0, stddev_pop(log2(cnt))) AS s FROM {hist} WHERE cnt > 0 GROUP BY 1, 2)"""


def _qc(min_reads: int) -> str:
    """Every pair's outcome: of the last step that it came to."""
    return f"""SELECT *, coalesce(frac_nonzero >= CAST({p.MIN_COV} AS DOUBLE) AND nreads >= {min_reads} AND frac_removed <= 0.25, false) AS passed_qc FROM (
        SELECT sample_id, genome_id, CASE WHEN raw >= {min_reads} AND cut1 <= 0.25 THEN covered END AS frac_nonzero,
            CASE WHEN raw < {min_reads} THEN raw WHEN cut1 > 0.25 THEN n1 ELSE n2 END AS nreads,
            CASE WHEN raw < {min_reads} THEN NULL WHEN cut1 > 0.25 THEN cut1 ELSE cut2 END AS frac_removed FROM pairs)"""


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    near = " - ".join(f"1 / ({x} + {k})" for k in range(6))
    return f"(ln({y}) - 0.5 / {y} - (1 / 12.0 - (1 / 120.0 - (1 / 252.0 - (1 / 240.0 - 1 / 132.0 / {y} / {y}) / {y} / {y}) / {y} / {y}) / {y} / {y}) / {y} / {y} - {near})"


def _rolling(reads: str) -> str:
    return f"""SELECT sample_id, genome_id, k, step, len, full_b, CAST(sum(c) OVER (PARTITION BY sample_id, genome_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS BIGINT) AS cnt FROM (
        SELECT g.sample_id, g.genome_id, g.k, g.step, g.len, g.full_b, count(r.pos) AS c FROM (SELECT *, unnest(range(CAST(ceil(len / step) AS BIGINT))) AS k FROM (
            SELECT sample_id, genome_id, max(ref_length) AS len, max(b) AS full_b, max(b) // 100 AS step FROM {reads} GROUP BY 1, 2)) g
        LEFT JOIN (SELECT sample_id, genome_id, pos, CAST(ceil(pos / (b // 100)) AS BIGINT) - 1 AS k FROM {reads}) r USING (sample_id, genome_id, k) GROUP BY ALL)"""


def _regions(flagged: str) -> str:
    """Islands of windows that are outside and not yet back inside."""
    return f"""SELECT sample_id, genome_id, min(k) * max(step) AS l, CASE WHEN max(k) + 1 >= ceil(max(len) / max(step)) THEN max(len) ELSE (max(k) + 1) * max(step) END AS r FROM (
        SELECT *, k - row_number() OVER (PARTITION BY sample_id, genome_id ORDER BY k) AS island FROM (
        SELECT *, last_value(CASE WHEN cnt > upper OR cnt < lower THEN 1 WHEN cnt < upper AND cnt > lower THEN 0 END IGNORE NULLS) OVER (PARTITION BY sample_id, genome_id ORDER BY k) AS state FROM {flagged})
        WHERE state = 1) GROUP BY sample_id, genome_id, island"""


def _removed(reads: str, regions: str) -> str:
    return f"""SELECT r.* REPLACE (r.pos - coalesce((SELECT CAST(sum(x.r - x.l) AS BIGINT) FROM {regions} x WHERE x.sample_id = r.sample_id AND x.genome_id = r.genome_id AND x.r <= r.pos), 0) AS pos,
        r.ref_length - coalesce(t.gone, 0) AS ref_length) FROM {reads} r LEFT JOIN (SELECT sample_id, genome_id, CAST(sum(r - l) AS BIGINT) AS gone FROM {regions} GROUP BY 1, 2) t USING (sample_id, genome_id)
        WHERE NOT EXISTS (SELECT 1 FROM {regions} x WHERE x.sample_id = r.sample_id AND x.genome_id = r.genome_id AND r.pos >= x.l AND r.pos < x.r)"""


def _bisect(name: str, source: str) -> str:
    """Sixty halvings towards the ratio whose expected distance is the mean."""
    return f"""SELECT sample_id, genome_id, mean_distance AS d, 0 AS i, CAST(1e-9 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi FROM {source} UNION ALL
        SELECT sample_id, genome_id, d, i + 1, CASE WHEN e > 2 * d THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e > 2 * d THEN hi ELSE (lo + hi) / 2 END FROM (
        SELECT *, 2 / ((lo + hi) * ln(2)) - 1 / (pow(2, (lo + hi) / 2) - 1) AS e FROM {name} WHERE i < 60)"""


PARTS |= {
    "qc": _qc(p.MIN_READS),
    "qc1": _qc(1),
    "vi": f"""SELECT *, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY sample_id, genomes) AS phi, 0 AS i FROM (
        SELECT sample_id, genomes, genome_id, reads, 1 + coalesce(prior, 0) AS alpha FROM (SELECT *, unnest(string_split(genomes, ',')) AS genome_id FROM classes) LEFT JOIN priors USING (sample_id, genome_id)) UNION ALL
        SELECT sample_id, genomes, genome_id, reads, alpha, e / sum(e) OVER (PARTITION BY sample_id, genomes), i + 1 FROM (
        SELECT *, exp({_digamma('eta')}) AS e FROM (SELECT *, alpha + sum(reads * phi) OVER (PARTITION BY sample_id, genome_id) AS eta FROM vi WHERE i < {STEPS}))""",
    "chosen": f"SELECT sample_id, genomes, genome_id AS chosen FROM vi WHERE i = {STEPS} QUALIFY row_number() OVER (PARTITION BY sample_id, genomes ORDER BY round(phi, 6) DESC, genome_id) = 1",
    "roll1": _rolling("complete"),
    "gb": _bounds("hist", Z95),
    "reg1_": _regions("(SELECT * FROM roll1 JOIN gb USING (sample_id, genome_id))"),
    "phase1": _removed("complete", "reg1_"),
    "roll2": _rolling("phase1"),
    "spread": """SELECT sample_id, genome_id, k AS k0, ((k + side * 100 * j) % n + n) % n AS k FROM (SELECT *, unnest(range(w)) AS j FROM (
        SELECT sample_id, genome_id, k, count(*) OVER (PARTITION BY sample_id, genome_id) AS n, greatest(4, CAST(ceil(0.0625 * len / full_b) AS BIGINT)) AS w FROM roll2)),
        (SELECT unnest([-1, 1]) AS side)""",
    "near": """SELECT sample_id, genome_id, k0 AS k, median(cnt) AS m, log2(median(cnt) FILTER (cnt > 0)) AS mid, greatest(1.0, stddev_pop(log2(CASE WHEN cnt > 0 THEN cnt END))) AS s
        FROM spread JOIN roll2 USING (sample_id, genome_id, k) GROUP BY 1, 2, 3""",
    "flag2": f"""SELECT r.*, first_value(pow(2, mid - {Z975}::DOUBLE * s)) OVER w AS lower, first_value(pow(2, mid + {Z975}::DOUBLE * s)) OVER w AS upper FROM roll2 r JOIN near USING (sample_id, genome_id, k)
        WINDOW w AS (PARTITION BY sample_id, genome_id, m ORDER BY k)""",
    "reg2_": _regions("flag2"),
    "phase2": _removed("phase1", "reg2_"),
    "fixed_": "SELECT DISTINCT sample_id, genome_id, unnest([100000, 400000]) AS l, unnest([150000, 420000]) AS r FROM complete",
    "fit_": _bisect("fit_", "med"),
    "refit_": _bisect("refit_", "shared_cost"),
    "evroll": _rolling("ev"),
    "evgb": _bounds("evhist", Z95),
    "evreg_": _regions("(SELECT * FROM evroll JOIN evgb USING (sample_id, genome_id))"),
}

READ = "sample_id, read_id, ref_name, pos, as_score"
SITE = "SELECT sample_id, genome_id, read_id, pos, ref_length FROM"
_pivot = lambda source, value, zero: "SELECT genome_id, " + ", ".join(f"coalesce(max({value}) FILTER (sample_id = 'S{i}'), {zero}) AS S{i}" for i in range(4)) + f" FROM {source} GROUP BY 1"

FINAL = {
    "ref_sequences": "SELECT sample_id, ref_name, length FROM header",
    "ref_genomes": "SELECT sample_id, count(*) AS n_sequences, count(DISTINCT genome_id) AS n_genomes FROM header GROUP BY 1",
    "sample_domain": "SELECT DISTINCT sample_id FROM aln",
    "flag_filter": f"SELECT {READ} FROM aln WHERE flag & 644 = 0",
    "identity_filter": f"SELECT {READ} FROM aln WHERE 10 * as_score >= -3 * query_length",
    "best_hits": f"SELECT {READ}, n_hits FROM best",
    "genome_projection": "SELECT ref_name, genome_id, count(*) AS n_hits FROM best GROUP BY 1, 2",
    "bin_coverage": "SELECT sample_id, genome_id, covered, total, round(fraction, 6) AS fraction FROM cov",
    "ambiguous_reads": "SELECT * FROM multi",
    "prior_counts": "SELECT * FROM priors",
    "multimap_classes": "SELECT * FROM classes",
    "vi_weights": f"SELECT sample_id, genomes, genome_id, reads, round(phi, 4) AS phi, chosen FROM vi JOIN chosen USING (sample_id, genomes) WHERE i = {STEPS}",
    "multimap_assignment": MAPPED_ASSIGNED,
    "positions_per_sequence": """SELECT h.sample_id, h.genome_id, h.ref_name, h.length, count(u.pos) AS n_reads, min(u.pos) AS first_pos, max(u.pos) AS last_pos, CAST(sum(u.pos) AS BIGINT) AS sum_pos
        FROM header h LEFT JOIN mapped u USING (sample_id, genome_id, ref_name) GROUP BY 1, 2, 3, 4""",
    "position_lists": """SELECT h.sample_id, h.genome_id, h.ref_name, h.length, coalesce(chunk, 0) AS chunk, coalesce(positions, '') AS positions, coalesce(reads, '') AS reads FROM header h LEFT JOIN (
        SELECT sample_id, genome_id, ref_name, chunk, string_agg(pos, ',' ORDER BY pos) AS positions, string_agg(n, ',' ORDER BY pos) AS reads FROM (
        SELECT sample_id, genome_id, ref_name, pos // 100000 AS chunk, pos, count(*) AS n FROM mapped GROUP BY ALL) GROUP BY 1, 2, 3, 4) USING (sample_id, genome_id, ref_name)""",
    "genome_kind": "SELECT * FROM kind",
    "coverage_map_scan": "SELECT sample_id, genome_id, ref_name, count(*) AS n_reads, CAST(sum(pos) AS BIGINT) AS sum_pos FROM mapped GROUP BY 1, 2, 3",
    "sam_round_trip": "SELECT read_id, flag, ref_name, pos, as_score, query_length, 'AS:i:' || as_score AS tags FROM aln",
    "bam_round_trip": "SELECT sample_id, read_id, flag, ref_name, pos, as_score, query_length, 'AS:i:' || as_score AS tags FROM aln",
    # Every file has the dictionary of all.
    "bam_header": "SELECT sample_id, ref_name, length FROM (SELECT DISTINCT sample_id FROM header), (SELECT DISTINCT ref_name, length FROM header)",
    "merge_best_score": "SELECT read_id, ref_name, pos, as_score FROM aln WHERE flag & 644 = 0 QUALIFY rank() OVER (PARTITION BY read_id ORDER BY as_score DESC) = 1",
    "min_reads_prefilter": f"SELECT sample_id, genome_id, count(*) AS n_reads FROM mapped GROUP BY 1, 2 HAVING count(*) >= {p.MIN_READS}",
    "incremental_extract": "SELECT sample_id, genome_id, count(*) AS n_reads FROM mapped WHERE sample_id NOT IN (SELECT 'S' || (o_orderkey % 4) FROM orders WHERE o_orderkey % 4 < 2) GROUP BY 1, 2",
    "ref_bin_size": f"SELECT sample_id, genome_id, (length // {p.BINS}) - (length // {p.BINS}) % 100 AS bin_size FROM header JOIN kind USING (sample_id, genome_id) WHERE NOT is_assembly",
    "ref_histogram": "SELECT * FROM hist",
    "genomewide_bounds": "SELECT sample_id, genome_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM gb",
    "local_bounds": "SELECT sample_id, genome_id, k, cnt, round(lower, 6) AS lower, round(upper, 6) AS upper FROM flag2",
    "rolling_counts": "SELECT sample_id, genome_id, k, cnt FROM roll1",
    "outlier_regions": "SELECT * FROM reg1",
    "phase1_filter": f"{SITE} phase1",
    "region_compaction": f"{SITE} ({_removed('complete', 'fixed_')})",
    "phase2_regions": "SELECT * FROM reg2",
    "phase2_filter": f"{SITE} phase2",
    "ref_filter_pipeline": f"{SITE} kept",
    "ref_qc": "SELECT sample_id, genome_id, round(frac_nonzero, 6) AS frac_nonzero, nreads, round(frac_removed, 6) AS frac_removed, passed_qc FROM qc",
    "contig_bin_size": "SELECT sample_id, genome_id, ref_name, bin_size, n_bins FROM csizes",
    "contig_histogram": "SELECT * FROM chist",
    "contig_qc": "SELECT sample_id, genome_id, total_bins, zero_bins, n_reads, round(frac_nonzero, 6) AS frac_nonzero, passed_qc FROM cqc",
    "coverage_matrix": "SELECT * FROM matrix",
    "masked_matrix": "SELECT * FROM masked",
    "sample_gate": "SELECT genome_id, sample_id, reads, round(frac_masked, 6) AS frac_masked, kept FROM sgate",
    "min_samples_gate": "SELECT * FROM msgate",
    "bin_gate": "SELECT * FROM bgate",
    "poisson_factor_order": "SELECT genome_id, bin_ix, round(w, 4) AS w, place FROM binorder",
    "reordered_bins": "SELECT genome_id, sample_id, place, cnt FROM masked JOIN msgate USING (genome_id, sample_id) JOIN binorder USING (genome_id, bin_ix)",
    "trimmed_bins": "SELECT * FROM trim",
    "contig_mle": "SELECT genome_id, sample_id, round(slope, 5) AS slope, round(abs(slope), 5) AS log2_ptr, reads, round(cov_frac, 5) AS cov_frac FROM cfit",
    "ols_slope": """SELECT genome_id, sample_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (
        SELECT genome_id, sample_id, cnt, log2(cnt) AS y, ix / max(ix) OVER (PARTITION BY genome_id, sample_id) AS x FROM trim) WHERE cnt > 0 GROUP BY 1, 2""",
    "ref_log_likelihood_grid": "SELECT sample_id, genome_id, log2_ptr, ori, ter, round(log_lk, 5) AS log_lk FROM ll",
    "multisample_ll_grid": "SELECT genome_id, log2_ptr, ori, ter, round(sum(log_lk), 5) AS log_lk FROM ll GROUP BY 1, 2, 3, 4",
    "free_terminus_ptr": """SELECT sample_id, genome_id, round(abs(a) * (x2 - x1), 5) AS log2_ptr, CASE WHEN a > 0 THEN x2 ELSE x1 END AS ori, CASE WHEN a > 0 THEN x1 ELSE x2 END AS ter, round(log_lk, 5) AS log_lk
        FROM free QUALIFY row_number() OVER (PARTITION BY sample_id, genome_id ORDER BY round(log_lk, 6) DESC, i, j) = 1""",
    "circular_median": "SELECT * REPLACE (round(mean_distance, 9) AS mean_distance) FROM med",
    "single_sample_ptr": "SELECT sample_id, genome_id, round(log2_ptr, 5) AS log2_ptr FROM fit",
    "shared_origin": "SELECT genome_id, round(ori, 6) AS ori, round(ter, 6) AS ter FROM shared",
    "ptr_refit": "SELECT sample_id, genome_id, round(ori, 5) AS ori, round(ter, 5) AS ter, round(log2_ptr, 5) AS log2_ptr FROM refit",
    "ptr_estimates_ref": "SELECT sample_id, genome_id, round(log2_ptr, 5) AS log2_ptr, round(ori, 5) AS ori, round(ter, 5) AS ter, nreads, round(cov_frac, 5) AS cov_frac FROM rest",
    "ptr_estimates_contig": "SELECT genome_id, sample_id, round(log2_ptr, 3) AS log2_ptr, reads, round(cov_frac, 3) AS cov_frac FROM cest",
    "ptr_table": "SELECT * FROM (" + _pivot("(SELECT sample_id, genome_id, round(round(log2_ptr, 6), 4) AS v FROM rest UNION ALL SELECT sample_id, genome_id, round(round(log2_ptr, 6), 4) FROM cest)", "v", "NULL") + ") WHERE coalesce(S0, S1, S2, S3) IS NOT NULL",
    "read_counts": "SELECT * FROM rcount",
    "read_counts_pivot": _pivot("rcount", "count", "0"),
    "relative_abundance": "SELECT sample_id, genome_id, round(rel_abun, 9) AS rel_abun FROM abun",
    "relative_abundance_pivot": _pivot("(SELECT sample_id, genome_id, round(rel_abun, 9) AS v FROM abun)", "v", "0.0"),
    "plot_data_ref": """SELECT sample_id, genome_id, bin_ix, round(cnt / total, 6) AS prob, round(lower / total, 6) AS lower, round(upper / total, 6) AS upper,
        round(r * ln(2) / (1 - pow(2, -r)) * pow(2, -2 * r * least(abs(x - o), 1 - abs(x - o))) / n, 6) AS density FROM (
        SELECT h.*, sum(cnt) OVER w AS total, count(*) OVER w AS n, (bin_ix + 0.5) / count(*) OVER w AS x, lower, upper, f.log2_ptr AS r, m.ori_pos / m.ref_length AS o
        FROM hist h JOIN gb USING (sample_id, genome_id) JOIN fit f USING (sample_id, genome_id) JOIN med m USING (sample_id, genome_id) WINDOW w AS (PARTITION BY sample_id, genome_id))""",
    "plot_data_contig": """SELECT genome_id, sample_id, place, round(cnt / sum(cnt) OVER w, 5) AS prob, round(e / sum(e) OVER w, 5) AS fitted FROM (
        SELECT *, pow(2, abs(slope) * place / (n - 1)) AS e FROM (SELECT t.genome_id, t.sample_id, t.cnt, c.n, c.slope, CASE WHEN c.slope < 0 THEN c.n - 1 - t.ix ELSE t.ix END AS place
        FROM trim t JOIN cfit c USING (genome_id, sample_id))) WINDOW w AS (PARTITION BY genome_id, sample_id)""",
    "fastq_name_normalise": """SELECT page_id, regexp_replace(url || CASE page_id % 3 WHEN 0 THEN '.fastq.gz' WHEN 1 THEN '.fq' ELSE '' END, '((\\.[^./]+)?\\.gz|\\.[^./]+)$', '') AS name FROM pages""",
    "fasta_header_rewrite": r"""SELECT 'refs/g' || (page_id % 7) || '.fa' AS file, page_id, CAST(i - 1 AS INTEGER) AS line_no,
        CASE WHEN lines[i] LIKE '>%' THEN '>g' || (page_id % 7) || '|' || substr(lines[i], 2) ELSE lines[i] END AS value FROM (
        SELECT page_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
        SELECT page_id, string_split_regex(CASE WHEN page_id % 3 = 0 THEN '>' || url || chr(10) ELSE '' END || coalesce(html, ''), '\r\n|\r|\n') AS lines FROM pages))""",
    "fasta_genomes": "SELECT DISTINCT 'g' || (page_id % 7) AS genome_id FROM pages",
    "mate_pairing": """SELECT 'P' || (o_orderkey // 2) AS sample, min('P' || (o_orderkey // 2) || '_1.fastq.gz') FILTER (o_orderkey % 2 = 0) AS first, min('P' || (o_orderkey // 2) || '_2.fastq.gz') FILTER (o_orderkey % 2 = 1) AS second
        FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) = 2""",
    "event_rolling_counts": "SELECT sample_id, genome_id, k, cnt FROM evroll",
    "event_outlier_regions": "SELECT * FROM evreg",
}


def sql(assigned: bool = False) -> dict[str, str]:
    """Each query with the parts that it needs before it; if `assigned`, with multi-mapped reads at their genomes."""
    parts = PARTS | ({"mapped": MAPPED_ASSIGNED} if assigned else {})

    def needs(text: str, seen: dict[str, None], above: tuple[str, ...] = ()) -> None:
        for name in parts:
            if name not in seen and name not in above and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                needs(parts[name], seen, (*above, name))
                seen[name] = None

    out = {}
    for key, text in FINAL.items():
        seen: dict[str, None] = {}
        needs(text, seen)
        out[key] = ("WITH RECURSIVE " + ", ".join(f"{n} AS ({parts[n]})" for n in seen) + " " if seen else "") + text
    return out
