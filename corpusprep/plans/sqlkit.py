"""SQL fragments for the independent DuckDB oracles.

These are written from the operator semantics (not generated from Spark
plans); they only keep repeated pieces — the portable uniform, the word
splitter, the special-token table — identical across oracle queries.
"""

from __future__ import annotations

from ..functions import constants as K

WS = r"[ \t\n\r\f]+"
MARKER = r"(<\|[a-z_0-9]+\|>)"
MARKER_FULL = r"<\|[a-z_0-9]+\|>"
EDGE_WS = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def u(tag: str, *keys: str, seed: int = 0) -> str:
    """Portable uniform: first 52 bits of md5('seed|tag|k1|...')."""
    parts = ", ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return (f"(CAST(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) AS BIGINT) AS DOUBLE)"
            f" / 4503599627370496.0)")


def gumbel(u_expr: str) -> str:
    return f"(-ln(greatest(-ln(greatest({u_expr}, 1e-20)), 1e-20)))"


def tokens(text_expr: str) -> str:
    """Word tokens with special markers split out."""
    return (f"list_filter(regexp_split_to_array(regexp_replace(coalesce({text_expr}, ''), "
            f"'{MARKER}', ' \\1 ', 'g'), '{WS}'), lambda x: x <> '')")


def strip_ws(text_expr: str) -> str:
    return f"regexp_replace({text_expr}, '{EDGE_WS}', '', 'g')"


def specials_values() -> str:
    rows = ", ".join(f"('{t}', {i})" for t, i in sorted(K.SPECIAL_TOKENS.items(), key=lambda kv: kv[1]))
    return f"(SELECT * FROM (VALUES {rows}) AS s(token, id))"


def vocab_from(token_rows_sql: str, max_size: int = K.MAX_WORD_VOCAB) -> str:
    """Word vocabulary (token, id) from a subquery with column ``token``,
    plus specials."""
    return f"""(
  SELECT token, id FROM (
    SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 AS INTEGER) AS id
    FROM (SELECT token, count(*) AS cnt FROM ({token_rows_sql}) tr
          WHERE NOT regexp_full_match(token, '{MARKER_FULL}') GROUP BY token) c
  ) v WHERE id < {max_size}
  UNION ALL SELECT token, id FROM {specials_values()}
)"""


def segment(role: str = "role", text: str = "text", close_tag: str = K.EOT_TOKEN) -> str:
    return (f"('{K.START_HEADER_TOKEN}' || {role} || '{K.END_HEADER_TOKEN}' || chr(10) || "
            f"{strip_ws(f'coalesce({text}, {chr(39)}{chr(39)})')} || '{close_tag}')")
