"""SQL fragments shared by the checking queries, and the way they are assembled."""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql


def q(body: str) -> str:
    """Prefix a statement with the fragments that it names, directly or through others."""
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in FRAGMENTS:
            if name not in needed and name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                visit(FRAGMENTS[name])
                open_names.discard(name)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    recursive = "RECURSIVE " if any("RECURSIVE" in FRAGMENTS[n] for n in needed) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({FRAGMENTS[n].replace('/*RECURSIVE*/', '')})" for n in needed) + "\n" + body


fragment("s_base", """
SELECT doc_id AS sample_id, lang AS grp, source AS resolution, CAST(n_chars AS DOUBLE) AS target,
  CAST(len(string_split(text, ' ')) AS DOUBLE) AS words,
  CAST(length(text) - length(translate(text, chr(10), '')) + 1 AS DOUBLE) AS lines,
  CAST(length(text) - length(translate(text, '0123456789', '')) AS DOUBLE) AS digits,
  CAST(length(text) - length(translate(text, ',', '')) AS DOUBLE) AS commas,
  CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS DOUBLE) AS capitals,
  CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) AS distinct_words
FROM documents""")
fragment("s_cat", """
SELECT *, LEAST((row_number() OVER (ORDER BY target, sample_id) - 1) * 10 // count(*) OVER () + 1, 10) AS cno
FROM s_base""")
fragment("s_split", """
SELECT *, 'B' || cno AS category,
  (row_number() OVER (ORDER BY cno, sha256('42:' || sample_id), sample_id) - 1) % 5 + 1 AS fold
FROM s_cat""")
fragment("o_base", """
SELECT o_orderkey AS sample_id, o_orderpriority AS grp, o_orderstatus AS resolution, o_totalprice AS target FROM orders""")
fragment("o_split", """
SELECT *, 'B' || cno AS category,
  (row_number() OVER (ORDER BY cno, sha256('42:' || sample_id), sample_id) - 1) % 5 + 1 AS fold
FROM (SELECT *, LEAST((row_number() OVER (ORDER BY target, sample_id) - 1) * 10 // count(*) OVER () + 1, 10) AS cno FROM o_base)""")
fragment("folds5", "SELECT unnest(range(1, 6)) AS outer_fold")
fragment("s_train", "SELECT s.*, f.outer_fold FROM s_split s JOIN folds5 f ON s.fold <> f.outer_fold")
fragment("s_lines", """
SELECT outer_fold AS fold, avg(target) AS train_mean,
  regr_slope(target, words) AS slope_words, regr_intercept(target, words) AS intercept_words,
  regr_slope(target, lines) AS slope_lines, regr_intercept(target, lines) AS intercept_lines,
  regr_slope(target, digits) AS slope_digits, regr_intercept(target, digits) AS intercept_digits
FROM s_train GROUP BY outer_fold""")
fragment("s_gmeans", "SELECT outer_fold AS fold, grp, avg(target) AS group_mean FROM s_train GROUP BY outer_fold, grp")
fragment("s_wide", """
SELECT s.*, l.train_mean, coalesce(g.group_mean, l.train_mean) AS p_group,
  slope_words * words + intercept_words AS p_words, slope_lines * lines + intercept_lines AS p_lines,
  slope_digits * digits + intercept_digits AS p_digits
FROM s_split s JOIN s_lines l USING (fold) LEFT JOIN s_gmeans g ON g.fold = s.fold AND g.grp = s.grp""")
fragment("s_pred", """
SELECT sample_id, grp, resolution, category, fold, target AS observed, 'mean_reference' AS configuration, 'mean' AS approach, 'reference' AS role, train_mean AS predicted FROM s_wide
UNION ALL SELECT sample_id, grp, resolution, category, fold, target, 'group_mean', 'mean', 'candidate', p_group FROM s_wide
UNION ALL SELECT sample_id, grp, resolution, category, fold, target, 'line_words', 'least_squares', 'candidate', p_words FROM s_wide
UNION ALL SELECT sample_id, grp, resolution, category, fold, target, 'line_lines', 'least_squares', 'candidate', p_lines FROM s_wide
UNION ALL SELECT sample_id, grp, resolution, category, fold, target, 'line_digits', 'least_squares', 'candidate', p_digits FROM s_wide""")

def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, {digits}) + 0.0 AS {name}"
