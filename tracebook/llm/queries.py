"""The registered queries of the nine problems and their SQL."""

from __future__ import annotations

from tracebook.llm import p1, p2, p3, p4, p5, p6, p7, p8, p9

QUERIES = {"p1_found": p1.p1_found, "p2_found": p2.p2_found, "p2_groups": p2.p2_groups, "p3_found": p3.p3_found, "p3_forms": p3.p3_forms, "p4_found": p4.p4_found, "p4_shares": p4.p4_shares, "p5_found": p5.p5_found, "p5_faults": p5.p5_faults, "p5_paragraphs": p5.p5_paragraphs, "p6_found": p6.p6_found, "p6_pieces": p6.p6_pieces, "p7_found": p7.p7_found, "p7_coverage": p7.p7_coverage, "p7_leaks": p7.p7_leaks, "p7_items": p7.p7_items, "p8_mixture": p8.p8_mixture, "p8_shares": p8.p8_shares, "p9_found": p9.p9_found, "p9_quality": p9.p9_quality}
ORACLE_SQL = {"p1_found": p1.P1_FOUND_SQL, "p2_found": p2.P2_FOUND_SQL, "p2_groups": p2.P2_GROUPS_SQL, "p4_found": p4.P4_FOUND_SQL, "p4_shares": p4.P4_SHARES_SQL, "p6_found": p6.P6_FOUND_SQL, "p7_found": p7.P7_FOUND_SQL}
