"""The SQL twin of the conversation repair: a recursive query whose step is a turn. A path is {c: cost, a: audit, o: repaired turns, each behind a line feed}; a cost of 10^9 is no path."""

from __future__ import annotations

_NONE = "{'c': 1000000000, 'a': '', 'o': ''}"
_BARE = "trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _path(before: str, cost: str, letter: str, turn: str) -> str:
    return f"{{'c': {before}.c + {cost}, 'a': {before}.a || '{letter}', 'o': {before}.o || {turn}}}"


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _closed(source: str, keys: str) -> str:
    for _ in range(2):
        user = _least("p2", *(_path(p, "3", "I", "chr(10) || 'user:'") for p in ("p0", "p1", "p3")))
        assistant = _least("p3", _path("p2", "3", "I", "chr(10) || 'assistant:'"))
        source = f"(SELECT {keys}, p0, p1, {user} AS p2, {assistant} AS p3 FROM {source})"
    return source


def _step() -> str:
    kept = lambda p, initial: f"CASE WHEN initial = '{initial}' AND fault NOT IN (1, 2) THEN {_path(p, 'more', 'K', "chr(10) || role || ':' || text")} ELSE {_NONE} END"
    other = lambda p, role: f"CASE WHEN fault NOT IN (1, 2) THEN {_path(p, '3 + more', 'R', f"chr(10) || '{role}:' || text")} ELSE {_NONE} END"
    gone = lambda p: _path(p, "4", "D", "''")
    user = [f(p, "u" if f is kept else "user") for p in ("p0", "p1", "p3") for f in (kept, other)]
    states = (gone("p0"), _least(gone("p1"), kept("p0", "s")), _least(gone("p2"), *user), _least(gone("p3"), kept("p2", "a"), other("p2", "assistant")))
    taken = f"(SELECT j.conv_id, j.k, {', '.join(f'{s} AS p{n}' for n, s in enumerate(states))} FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.k = s.k + 1)"
    return _closed(taken, "conv_id, k")


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""

REPAIR = f"""
WITH RECURSIVE marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS time
    FROM marked WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text), time) AS k, left(role, 1) AS initial FROM damaged),
judged AS (
    SELECT *, CASE WHEN {_BARE} = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right({_BARE}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        CASE WHEN right({_BARE}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair
    FROM placed),
steps AS (
    SELECT * FROM {_closed("(SELECT DISTINCT conv_id, 0::BIGINT AS k, {'c': 0, 'a': '', 'o': ''} AS p0, " + ", ".join(f"{_NONE} AS p{n}" for n in (1, 2, 3)) + " FROM judged)", "conv_id, k")}
    UNION ALL
    SELECT * FROM {_step()}),
counts AS (
    SELECT conv_id, max(k) AS k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id),
chosen AS (
    SELECT c.*, {_least("p0", "p3")} AS p FROM counts c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.k = s.k),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(p.c, 0)::BIGINT AS cost, coalesce(p.a, '') AS audit, sha256(coalesce(substr(p.o, 2), '')) AS repaired_sha256
FROM ids i LEFT JOIN chosen c ON i.conv_id IS NOT DISTINCT FROM c.conv_id"""
