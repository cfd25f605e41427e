"""DuckDB SQL for the queries that SQL can express over whole tables in a short time."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR_JOIN = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) g from w),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
e as (select x, y from l union select y, x from l),
reach as (select doc_id d, doc_id m from documents union select e.y, r.m from reach r join e on e.x = r.d)
select d.doc_id, coalesce(n.n, 0) n_shingles, r.component_id from documents d left join n on n.doc_id = d.doc_id
join (select d, min(m) component_id from reach group by 1) r on r.d = d.doc_id"""

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 18)) i from w where len(ws) >= 20),
k as (select doc_id, i, row_number() over (partition by array_to_string(ws[i:i + 19], ' ') order by doc_id, i) rn from p),
gone as (select distinct doc_id, i + j pos from k, range(20) t(j) where rn > 1),
each as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) pos from w),
kept as (select e.doc_id, string_agg(word, ' ' order by pos) t, count(*) n from each e where not exists (select 1 from gone g where g.doc_id = e.doc_id and g.pos = e.pos) group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(kept.n, 0) as bigint) n_removed, sha256(coalesce(kept.t, '')) kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""

VECTOR_DEDUP = """
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and embedding is not null),
l as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
e as (select x, y from l union select y, x from l),
reach as (select vec_id d, vec_id m from embeddings union select e.y, r.m from reach r join e on e.x = r.d),
n as (select x, count(*) n from e group by 1)
select b.vec_id, coalesce(n.n, 0) n_links, r.component_id, b.vec_id = r.component_id kept from embeddings b left join n on n.x = b.vec_id
join (select d, min(m) component_id from reach group by 1) r on r.d = b.vec_id"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of CRC-32 by byte, from its polynomial; a text's CRC is a fold over its bytes.
CRC_TABLE = "crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b::bigint)) crcs)"
BYTES = "list_transform(range(1, length(hex(encode({0}))) // 2 + 1), lambda i: (instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 1)"


def _crc(text: str) -> str:
    return f"xor(list_reduce({BYTES.format(text)}, lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1]), 4294967295::bigint), 4294967295)"


def _merkle(levels: int = 7, fan: int = 8) -> str:
    """Levels are written out: enough for fan ** levels rows of a group and groups."""
    field = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    out = [f"with {CRC_TABLE}", f"own as (select doc_id, lang, {leaf('text')} leaf, case when {_crc('cast(doc_id as varchar)')} % 3 = 0 then {leaf('lowered')} else {leaf('text')} end folded0 from (select *, {LOWER.format('text')} lowered from documents), crc)",
           "t0 as (select 'd' tree, lang g, row_number() over (partition by lang order by doc_id, leaf) - 1 i, count(*) over (partition by lang) n, leaf h, doc_id from own)"]

    def climb(name: str) -> list[str]:
        made = []
        for k in range(levels):
            made.append(f"{name}r{k} as (select g, i // {fan} i, max(n) n, list(h order by i) run from {name}{k} where n > 1 group by g, i // {fan})")
            made.append(f"{name}{k + 1} as (select g, i, (n + {fan - 1}) // {fan} n, sha256(array_to_string(run, '')) h from {name}r{k})")
        made.append(f"{name}top as ({' union all '.join(f'select g, h from {name}{k} where n = 1' for k in range(levels + 1))})")
        return made

    out += climb("t")
    out.append("u0 as (select 0 g, row_number() over (order by g nulls first) - 1 i, count(*) over () n, h, g lang from ttop)")
    out += climb("u")

    # A proof as its siblings' text, and the folded digest, level by level.
    def fold(name: str, start: str, group: str, keep: str) -> list[str]:
        made = [f"{name}f0 as ({start})"]
        for k in range(levels):
            at = f"cast((i // {fan ** k}) % {fan} as int)"
            made.append(
                f"""{name}f{k + 1} as (select {keep}, f.i, proof || coalesce(array_to_string(run[1:{at}], '') || array_to_string(run[{at} + 2:], ''), '') proof,
                case when run is null then h else sha256(array_to_string(run[1:{at}], '') || h || array_to_string(run[{at} + 2:], '')) end h from {name}f{k} f left join (select g rg, i ri, run from {name}r{k}) r on {group} is not distinct from rg and f.i // {fan ** (k + 1)} = ri)"""
            )
        return made

    out += fold("t", "select o.doc_id, o.lang, o.leaf, t.i, '' proof, o.folded0 h from own o join t0 t on t.doc_id = o.doc_id", "lang", "doc_id, lang, leaf")
    out += fold("u", f"select doc_id, f.lang, leaf, subroot, u.i, proof, f.h from (select f.*, ttop.h subroot from tf{levels} f join ttop on f.lang is not distinct from ttop.g) f join u0 u on u.lang is not distinct from f.lang", "0", "doc_id, leaf, subroot")
    return ", ".join(out) + f" select doc_id, leaf, subroot, utop.h root, sha256(proof) proof_sha256, f.h folded_root, f.h = utop.h verified from uf{levels} f, utop"


MERKLE = _merkle()

IMPORTANCE = rf"""
with {CRC_TABLE},
texts as (select 'd' side, doc_id, {LOWER.format("coalesce(text, '')")} t from documents union all select 'b', item_id, {LOWER.format("coalesce(text, '')")} from benchmark),
w as (select side, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from texts),
f as (select side, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) f from w),
hashed as (select f, {_crc('f')} % 10000 bucket from (select distinct f from f), crc),
placed as (select side, doc_id, bucket from f join hashed using (f)),
many as (select bucket, count(*) filter (side = 'd') s, count(*) filter (side = 'b') t from placed group by 1),
whole as (select count(*) filter (side = 'd') ss, count(*) filter (side = 'b') tt from placed),
gain as (select bucket, cast(floor(1000 * ln((t + 1)::double * (ss + 10000)::double / ((s + 1)::double * (tt + 10000)::double))) as bigint) gain from many, whole),
weights as (select doc_id, count(*) n, cast(floor(sum(gain)::bigint / count(*)) as bigint) weight from placed join gain using (bucket) where side = 'd' group by 1),
hexes as (select doc_id, list_sum(list_transform(range(8), lambda i: (instr('0123456789abcdef', substr(sha256('7:' || doc_id), i + 1, 1)) - 1) * cast(power(16, 7 - i) as bigint))) h from documents),
scored as (select w.doc_id, len(ws) words, coalesce(n, 0) n_features, coalesce(weight, 0) weight, cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) score
    from w join hexes using (doc_id) left join weights using (doc_id) where side = 'd'),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () n from scored where words >= 20)
select s.doc_id, cast(n_features as bigint) n_features, weight, score, case when rank <= floor(25 * n / 100) then rank end rank from scored s left join drawn using (doc_id)"""
