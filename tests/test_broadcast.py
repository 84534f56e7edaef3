"""No join may send what is made from a table through the driver; Spark guesses far too small a size for it."""

import re

import pytest

from __spark_entry__ import queries

#: Rows of one text each, as many as a query's tables have molecules, reads or features.
QUERIES = [
    "kmer_distance",
    "primer_specificity",
    "crispr_offtargets",
    "strand_vote",
    "aligned_identities",
    "aligned_columns",
    "cds_translate",
    "overhang_warnings",
    "cds_joined",
    "extract_region",
    "goldengate_walk",
    "prime_editing",
    "codon_usage",
    "protein_properties",
    "guide_specificity",
    "choose_construct",
    "verify_clones",
]


def sent(plan: str) -> list[str]:
    """The parts of a physical plan that are broadcast and read molecules, but for a fixed number of
    them and for a row an amino acid."""
    lines, out = plan.split("== Initial Plan ==")[-1].splitlines(), []
    depth = [re.match(r"[\s:+-]*", x).end() for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            n = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            part = "\n".join(lines[k:n])
            if "p_partkey" in part and not re.search(r"p_partkey#\d+L <= \d+", part) and "Aggregate(keys=[aa" not in "".join(lines[k + 1 : k + 4]):
                out.append(part)
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_no_molecules_broadcast(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" in plan
    assert sent(plan) == []
