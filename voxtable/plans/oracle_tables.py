"""Named tables in DuckDB SQL. ``with_tables`` puts the ones a query mentions in front of it."""
from __future__ import annotations

import re

from ..functions import fixed

TABLES: dict[str, str] = {}


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def table(name: str, sql: str) -> None:
    TABLES[name] = sql


def with_tables(sql: str) -> str:
    used, order = set(), []

    def need(text):
        for name in TABLES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                need(TABLES[name])
                order.append(name)
    need(sql)
    body = sql.strip()
    heads = [f"{n} AS ({TABLES[n]})" for n in order]
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(heads + [body[15:]])
    if body.upper().startswith("WITH "):
        heads.append(body[5:])
        return "WITH " + ",\n".join(heads)
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def talk_tables(prefix: str, source: str) -> None:
    table(f"{prefix}tok0", f"SELECT clip_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM ({source})")
    table(f"{prefix}tok1", f"""SELECT clip_id, turn, list_concat(CASE WHEN (clip_id + turn) % 4 = 1 THEN ['um,'] ELSE a[1:0] END,
      CASE WHEN (clip_id + turn) % 3 = 0 THEN a[1:8] ELSE a[1:0] END, a) AS a FROM {prefix}tok0""")
    table(f"{prefix}tok", f"SELECT clip_id, turn, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS text FROM {prefix}tok1")
    table(f"{prefix}tim", f"""SELECT clip_id, i, text, 120000 + 30000 * least(length(text), 12) AS dur_us,
      CASE WHEN i % 40 = 39 THEN 3000000 WHEN regexp_matches(text, '[.!?]$') THEN 600000 WHEN regexp_matches(text, '[,;:]$') THEN 200000 ELSE 20000 + 10000 * (i % 4) END AS gap_us
      FROM (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY turn, pos) - 1 AS i, text FROM {prefix}tok)""")
    table(f"{prefix}acc", f"SELECT *, coalesce(sum(dur_us + gap_us) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {prefix}tim")
    table(f"{prefix}words", f"SELECT clip_id, CAST(i AS INT) AS i, text, CAST(s AS BIGINT) AS start_us, CAST(s + dur_us AS BIGINT) AS end_us, CAST(s + dur_us + gap_us AS BIGINT) AS next_us FROM {prefix}acc")


talk_tables("", "SELECT conv_id AS clip_id, turn, text FROM conversations")
talk_tables("document_", "SELECT 1000000 + doc_id AS clip_id, CAST(0 AS BIGINT) AS turn, text FROM documents")

table("clips", """SELECT clip_id, max(next_us) AS duration_us, 1920 AS width, 1080 AS height,
  CASE WHEN clip_id % 5 = 0 THEN 30000 ELSE 30 END AS fps_num, CASE WHEN clip_id % 5 = 0 THEN 1001 ELSE 1 END AS fps_den,
  48000 AS sample_rate FROM words GROUP BY clip_id""")
table("lv0", "SELECT clip_id, i, start_us, end_us, next_us, unnest(generate_series(CAST(floor((start_us + 9999) / 10000) AS BIGINT), CAST(floor((next_us + 9999) / 10000) AS BIGINT) - 1)) AS frame FROM words")
table("levels", """SELECT clip_id, CAST(frame AS INT) AS frame, CAST(CASE WHEN frame * 10000 >= start_us + 60000 AND frame * 10000 < end_us - 40000
   THEN -18 - (i * 7) % 13
   WHEN i % 40 = 39 AND frame * 10000 >= end_us + 700000 AND frame * 10000 < end_us + CASE WHEN i % 80 = 79 THEN 2200000 ELSE 1100000 END THEN -25 ELSE -70 - (frame * 31 + clip_id) % 11 END AS DOUBLE) AS db FROM lv0""")
table("silences", """SELECT clip_id, CAST(min(frame) AS BIGINT) * 10000 AS start_us, (CAST(max(frame) AS BIGINT) + 1) * 10000 AS end_us
  FROM (SELECT clip_id, frame, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS g FROM levels WHERE db < -55)
  GROUP BY clip_id, g HAVING count(*) >= 10""")
table("fc", "SELECT clip_id, unnest(generate_series(0, n - 1)) AS sec FROM (SELECT clip_id, CAST(floor(duration_us / 1000000) AS BIGINT) AS n FROM clips)")
table("faces", """SELECT clip_id, CAST(sec AS INT) AS sec, CAST(k AS INT) AS face_ord, CAST(30 + (clip_id * 3 + sec + k * 11) % 30 AS DOUBLE) / 100 AS x, CAST(10 + (sec * 7 + k) % 20 AS DOUBLE) / 100 AS y,
   CAST(10 + (sec * 5 + k * 13) % 15 AS DOUBLE) / 100 AS w, CAST(12 + (sec * 3 + k * 7) % 15 AS DOUBLE) / 100 AS h
   FROM fc CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk WHERE k < (clip_id * 7 + sec * 3) % 3""")
table("menu", "SELECT * FROM (VALUES " + ", ".join(
    f"('{q}', {n}, '{label}', {o})" for n, (q, ls) in enumerate(fixed.MENUS.items()) for o, label in enumerate(ls))
    + ") t(question, q, label, label_ord)")
table("units", """SELECT clip_id, unit, first_i, last_i, CASE WHEN unit = 0 THEN 0 ELSE s END AS start_us,
  coalesce(lead(s) OVER (PARTITION BY clip_id ORDER BY unit), e) AS end_us
  FROM (SELECT clip_id, CAST(i // 8 AS BIGINT) AS unit, min(i) AS first_i, max(i) AS last_i, min(start_us) AS s, max(end_us) AS e FROM words GROUP BY ALL)""")
table("answers", """SELECT clip_id, unit, question, label, CAST(label_ord AS BIGINT) AS label_ord, wgt / sum(wgt) OVER (PARTITION BY clip_id, unit, question) AS prob
  FROM (SELECT clip_id, unit, question, label, label_ord,
    pow(1 + (clip_id * 17 + unit * 29 + label_ord * label_ord * 13 + unit * label_ord * 7 + q * 31) % 97, 3) AS wgt FROM units CROSS JOIN menu)""")
table("keeps", """SELECT clip_id, CAST(g - 1 AS BIGINT) AS k, min(start_us) AS start_us, max(end_us) AS end_us
  FROM (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY clip_id ORDER BY i) < 600000 THEN 0 ELSE 1 END AS b FROM words))
  GROUP BY clip_id, g""")
table("proposals", """SELECT clip_id, p AS p_ord, (clip_id * 13 + p * 59) % n AS from_i, (clip_id * 13 + p * 59) % n + (p % 9) * 2 AS to_i, 'proposal ' || p AS reason
  FROM (SELECT clip_id, n, unnest(generate_series(0, n // 60)) AS p FROM (SELECT clip_id, count(*) AS n FROM words GROUP BY clip_id))""")

# --- text forms -------------------------------------------------------------------------------
_CONTR = "CASE n " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.CONTRACTIONS.items()) + " ELSE n END"
table("nwords", f"""SELECT *, {_CONTR} AS nm, regexp_matches(text, '[.!?]["'')\\]]?$') AS sent_end, regexp_matches(text, ',["'')\\]]?$') AS comma_end
  FROM (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS n FROM words)""")
table("vwords", f"""SELECT *, length(t) >= 2 AND t NOT IN {sql_list(fixed.STOP_VERIFY)} AS content
  FROM (SELECT *, regexp_replace(replace(replace(lower(text), '‘', ''''), '’', ''''), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS t,
    regexp_matches(text, '[.!?]["'')\\]]?$') AS sent_end FROM words)""")
table("swords", """SELECT *, sum(CASE WHEN prev_end THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i) AS s_ord
  FROM (SELECT *, coalesce(lag(sent_end) OVER (PARTITION BY clip_id ORDER BY i), false) AS prev_end FROM vwords)""")
table("sents", """SELECT clip_id, CAST(s_ord AS BIGINT) AS s_ord, min(i) AS first_i, max(i) AS last_i, min(start_us) AS start_us, max(end_us) AS end_us,
  string_agg(text, ' ' ORDER BY i) AS text, coalesce(list_sort(list(DISTINCT t) FILTER (WHERE content)), CAST([] AS VARCHAR[])) AS content
  FROM swords GROUP BY clip_id, s_ord""")
