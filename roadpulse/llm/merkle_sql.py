"""The SQL of the Merkle manifest's digests: levels written out, a run's siblings as framed windows."""

from __future__ import annotations

#: Levels written out: trees of up to 16 ** 5 nodes.
LEVELS = 5


def _levels(name: str, start: str) -> str:
    """Tables ``{name}0`` .. of (g, idx, h, n), lefts and rights of each node's siblings, parents next."""
    parts = [f"{name}0 AS ({start})"]
    for k in range(LEVELS):
        parts.append(
            f"""{name}s{k} AS (
                SELECT g, idx, h, n,
                       CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
                       CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
                FROM {name}{k})"""
        )
        # A tree that has come to its end keeps its last node.
        parts.append(
            f"""{name}{k + 1} AS (
                SELECT g, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h,
                       (any_value(n) + 15) // 16 AS n
                FROM {name}{k} GROUP BY g, idx // 16)"""
        )
    return ",\n".join(parts)


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters, bit by bit."""
    step = "list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda crc, c: {step}), 4294967295::BIGINT)"


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


def manifest_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars"))
    nodes = [f"{tree}{k}" for tree in "st" for k in range(LEVELS)]
    proof = [f"{a}.l || {a}.r" for a in nodes]
    # Nodes of a finished tree are not hashed again.
    steps = ["f0 AS (SELECT *, x AS y FROM joined)"]
    for i, a in enumerate(nodes):
        steps.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN n_{a} > 1 THEN sha256(l_{a} || y || r_{a}) ELSE y END AS y) FROM f{i})")
    columns = ", ".join(f"{a}.n AS n_{a}, {a}.l AS l_{a}, {a}.r AS r_{a}" for a in nodes)
    joins = "\n".join(
        [f"JOIN ds{k} s{k} ON s{k}.g = p.g AND s{k}.idx = p.idx // {16**k}" for k in range(LEVELS)]
        + [f"JOIN us{k} t{k} ON t{k}.idx = u.idx // {16**k}" for k in range(LEVELS)]
    )
    return f"""
        WITH leaves AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS g, sha256({head} || {_field('text')}) AS leaf,
                   CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN sha256({head} || {_field(lower)}) END AS changed
            FROM documents
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n,
                   coalesce(changed, leaf) AS x
            FROM leaves
        ), {_levels('d', 'SELECT g, idx, leaf AS h, n FROM p')},
        sources AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM d{LEVELS}),
        {_levels('u', "SELECT 'root' AS g, idx, h, n FROM sources")},
        joined AS (
            SELECT p.doc_id, p.leaf, u.h AS subroot, (SELECT h FROM u{LEVELS}) AS root, p.x, {columns},
                   sha256({' || '.join(proof)}) AS proof_sha256
            FROM p JOIN sources u ON u.g = p.g
            {joins}
        ), {', '.join(steps)}
        SELECT doc_id, leaf, subroot, root, proof_sha256, y AS folded_root, y = root AS verified FROM f{len(nodes)}
    """
