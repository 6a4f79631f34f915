"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import elkan, mixing, pieces, pivots, pseudo_likelihood, quality_ranking, quality_rules, secrets, sharding, simhash, suffixes, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rule_ledger": quality_rules.op1_rule_ledger,
    "op2_pseudo_likelihood": pseudo_likelihood.op2_pseudo_likelihood,
    "op3_poisson_replicas": mixing.op3_poisson_replicas,
    "op4_quality_ranking": quality_ranking.op4_quality_ranking,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_feistel_shards": sharding.op6_feistel_shards,
    "op7_pivot_near_dups": pivots.op7_pivot_near_dups,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_simhash_near_dups": simhash.op9_simhash_near_dups,
    "op10_warc_archive": warc.op10_warc_archive,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_elkan_clusters": elkan.op13_elkan_clusters,
}

SQL: dict[str, str] = {
    "op1_rule_ledger": quality_rules.OP1_SQL,
    "op3_poisson_replicas": mixing.OP3_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op6_feistel_shards": sharding.OP6_SQL,
    "op10_warc_archive": warc.OP10_SQL,
    "op13_elkan_clusters": elkan.OP13_SQL,
}

#: Reports that operators make besides their main result.
REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"rule_ablations": quality_rules.rule_ablations}
REPORTS_SQL: dict[str, str] = {"rule_ablations": quality_rules.ABLATIONS_SQL}
