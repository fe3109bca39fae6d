"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

OP10 = """
with coded as (
        select vec_id, list_sum(list_transform(range(1, len(embedding) + 1),
            lambda i: case when embedding[i] > 0 then 1::hugeint << (i - 1)::int else 0::hugeint end)
            )::ubigint as code
        from embeddings),
    pairs as (
        select q.vec_id as query_id, r.vec_id, bit_count(xor(q.code, r.code))::int as distance
        from coded q, coded r where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by distance, vec_id))::int as rank,
       vec_id, distance
from pairs qualify rank <= 10
"""

#: The rule for copies in operators 1 and 9 rests on 64-bit hashes that the other engine lacks, so their tests hold
#: them against plain loops.
ORACLE: dict[str, str] = {"op10_exact_top_k": OP10}
