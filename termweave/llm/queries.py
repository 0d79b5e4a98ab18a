"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from termweave.llm import bpe, copies, lookalike, mapping, neighbors, packing, sentences, topn

QUERIES = {
    "p1_found": lookalike.p1_found,
    "p1_forms": lookalike.p1_forms,
    "p2_found": neighbors.p2_found,
    "p2_neighbours": neighbors.p2_neighbours,
    "p2_recall": neighbors.p2_recall,
    "p4_found": copies.p4_found,
    "p4_collapsed": copies.p4_collapsed,
    "p5_found": mapping.p5_found,
    "p5_unmatched": mapping.p5_unmatched,
    "p7_found": topn.p7_found,
    "p8_ids": bpe.p8_ids,
    "p9_containers": packing.p9_containers,
    "p9_fill": packing.p9_fill,
    "p9_bound": packing.p9_bound,
    "p10_found": sentences.p10_found,
    "p10_evidence": sentences.p10_evidence,
}

SQL = {
    "p4_found": copies.P4_SQL,
    "p4_collapsed": copies.P4_COLLAPSED_SQL,
    "p7_found": topn.P7_SQL,
}
