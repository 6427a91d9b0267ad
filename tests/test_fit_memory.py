"""What one task of a fit holds: pages of up to 64 MB for each sort, window and join that follow without a shuffle."""

import re

from oriscope.operators import fit_complete


def test_few_windows_hold_pages_at_once(spark):
    counts = spark.range(3000).selectExpr("concat('S', id % 3) as sample_id", "'G' as genome_id", "1000L as ref_length", "id * 7 % 1000 as pos")
    medians = fit_complete.circular_median(counts)
    plan = medians._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1
    assert {(r.sample_id, r.nreads) for r in medians.collect()} == {("S0", 1000), ("S1", 1000), ("S2", 1000)}
