"""The encoder-decoder once more, as SQL with recursive queries over lists of doubles: an account of the kernel that shares only its weights and vocabularies."""

from __future__ import annotations

import numpy as np


def _list(x: np.ndarray) -> str:
    return "[" + ", ".join(_list(v) if v.ndim else str(v) for v in x) + "]"


def _cell(x: str, w: str, r: str, b: str, units: int, rest: str, source: str) -> str:
    """rest, h and c after a step of an LSTM with input x over the rows of source, which have h and c."""
    u, sig = units, lambda z: f"(1 / (1 + exp(-{z})))"
    z = f"select {rest}, c, list_transform(range(1, {4 * u + 1}), lambda j: list_dot_product({x}, {w}[j]) + list_dot_product(h, {r}[j]) + {b}[j]) as z from {source}"
    c = f"select {rest}, z, list_transform(range(1, {u + 1}), lambda k: {sig(f'z[{u} + k]')} * c[k] + {sig('z[k]')} * tanh(z[{2 * u} + k])) as c from ({z})"
    return f"select {rest}, list_transform(range(1, {u + 1}), lambda k: {sig(f'z[{3 * u} + k]')} * tanh(c[k])) as h, c from ({c})"


def _begun(words: str, weights: dict[str, np.ndarray], vocab_in: dict[str, int], vocab_out: dict[str, int], steps_in: int) -> str:
    """A WITH clause that ends in `ready`: of each word that the vocabulary holds, the encoder's states by step and by unit, and its last state. words gives a column word."""
    units = weights["enc_r"].shape[0]
    turned = {k: v.T if k in ("enc_w", "enc_r", "query_w", "dec_w", "dec_r", "out_w") else v for k, v in weights.items()}
    given = ", ".join(f"{_list(v.astype(np.float32))}::float{'[]' * v.ndim}::double{'[]' * v.ndim} as {k}" for k, v in turned.items())
    letters = ["", *sorted(vocab_out, key=vocab_out.get)]
    none = f"list_transform(range({units}), lambda k: 0::double)"
    step = _cell("enc_embed[ids[t + 1] + 1]", "enc_w", "enc_r", "enc_b", units, "word, t", f"(select e.word, t, h, c, ids, p.* from enc e join ids using (word), p where t < {steps_in})")
    return f"""with recursive p as materialized (select {given}, [{', '.join(f"'{x}'" for x in letters)}] as letters),
known(ch, id) as (values {', '.join(f"('{c}', {i})" for c, i in vocab_in.items())}),
src as (select distinct word from ({words}) where word is not null),
spelt as (select word, i, substring(word, greatest(length(word) - {steps_in - 1}, 1)::int + i::int, 1) as ch from src, range({steps_in}) as r(i)),
ids as (select word, list(coalesce(id, 0) order by i) as ids from spelt left join known using (ch) where not exists (select 1 from (select word as w, unnest(string_split(word, '')) as x from src) where w = word and x <> '' and x not in (select ch from known)) group by word),
enc as (select word, 0 as t, {none} as h, {none} as c from ids union all select word, t + 1, h, c from ({step})),
seen as (select word, list(h order by t) as s from enc where t > 0 group by word),
ready as (select word, s, list_transform(range(1, {units + 1}), lambda k: list_transform(s, lambda v: v[k])) as by_unit, h, c from seen join (select word, h, c from enc where t = {steps_in}) using (word))"""


def _stepped(source: str, rest: str, units: int, additive: bool) -> str:
    """rest, h, c and the logits of the next token, for rows of source (rest, token, h, c) joined with ready and p."""
    asked = "dec_embed[token + 1]" if additive else f"list_transform(range(1, {units + 1}), lambda k: list_dot_product(dec_embed[token + 1], query_w[k]) + query_b[k])"
    query = f"select *, {asked} as q from {source}"
    one = f"list_dot_product(scale, list_transform(range(1, {units + 1}), lambda k: tanh(q[k] + v[k])))" if additive else "list_dot_product(q, v)"
    fit = f"select *, list_transform(s, lambda v: {one}) as f from ({query})"
    weight = f"select *, list_transform(f, lambda v: exp(v - list_max(f))) as e from ({fit})"
    context = f"select *, list_concat(list_transform(by_unit, lambda v: list_dot_product(e, v) / list_sum(e)), dec_embed[token + 1]) as x from ({weight})"
    cell = _cell("x", "dec_w", "dec_r", "dec_b", units, f"{rest}, out_w, out_b", f"({context})")
    return f"select {rest}, h, c, list_transform(range(1, len(out_b) + 1), lambda k: list_dot_product(h, out_w[k]) + out_b[k]) as logits from ({cell})"


TEXT = "trim(array_to_string(list_transform(list_filter(made, lambda x: x > 0), lambda x: letters[x + 1]), ''), '$')"


def greedy(words: str, weights: dict[str, np.ndarray], vocab_in: dict[str, int], vocab_out: dict[str, int], steps_in: int, steps: int) -> str:
    """A WITH clause that ends in `spelled` (word, latin): the greedy output, empty for a word with an unknown character."""
    units, end = weights["enc_r"].shape[0], vocab_out["$"]
    rows = f"(select d.word, n, token, made, d.h, d.c, s, by_unit, p.* from dec d join ready using (word), p where n < {steps} and (n = 0 or token <> {end}))"
    return f"""{_begun(words, weights, vocab_in, vocab_out, steps_in)},
dec as (select word, 0 as n, {vocab_out['^']} as token, []::int[] as made, h, c from ready
  union all select word, n + 1, best, made || [best], h, c from (select *, (list_position(logits, list_max(logits)) - 1)::int as best from ({_stepped(rows, 'word, n, made', units, 'scale' in weights)}))),
spelled as (select word, coalesce({TEXT}, '') as latin from src left join (select word, arg_max(made, n) as made from dec group by word) using (word), p)
"""


def k_best(words: str, weights: dict[str, np.ndarray], vocab_in: dict[str, int], vocab_out: dict[str, int], k: int, steps_in: int, steps: int) -> str:
    """word, guess and rank: the k best token sequences by beam search of width k, by mean log probability; a text counts once."""
    units, end = weights["enc_r"].shape[0], vocab_out["$"]
    rows = f"(select d.word, n, token, total, made, d.h, d.c, s, by_unit, p.* from dec d join ready using (word), p where n < {steps} and token <> {end})"
    logs = f"select *, list_transform(logits, lambda v: v - list_max(logits) - ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))) as l from ({_stepped(rows, 'word, n, total, made', units, 'scale' in weights)})"
    wide = f"select word, n + 1 as n, unnest(range(len(l))) as token, total + unnest(l) as total, made, h, c from ({logs})"
    return f"""{_begun(words, weights, vocab_in, vocab_out, steps_in)},
dec as (select word, 0 as n, {vocab_out['^']} as token, 0::double as total, []::int[] as made, h, c from ready
  union all select word, n, token::int, total, made || [token::int], h, c from (select *, row_number() over (partition by word order by total desc) as place from ({wide})) where place <= {k}),
whole as (select word, made, row_number() over (partition by word order by total / n desc, made) as place from dec where n > 0 and (token = {end} or n = {steps})),
texts as (select word, {TEXT} as guess, min(place) as place from whole, p where place <= {k} group by all)
select word, guess, (row_number() over (partition by word order by place))::int as rank from texts"""


def loss(words: str, weights: dict[str, np.ndarray], vocab_in: dict[str, int], vocab_out: dict[str, int], spelled: str, steps_in: int, places: int) -> str:
    """n and loss: places of all distinct words, and the mean cross-entropy of their true tokens. spelled: an expression of the right spelling of `word`; it is wrapped in ^ and $ and padded to `places` tokens after the first."""
    units = weights["enc_r"].shape[0]
    rows = f"(select d.word, n, total, ids, ids[n + 1] as token, d.h, d.c, s, by_unit, p.* from dec d join ready using (word) join truth using (word), p where n < {places})"
    logs = f"select *, list_max(logits) + ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) as whole from ({_stepped(rows, 'word, n, total, ids', units, 'scale' in weights)})"
    return f"""{_begun(words, weights, vocab_in, vocab_out, steps_in)},
letter(ch, id) as (values {', '.join(f"('{c}', {i})" for c, i in vocab_out.items())}),
truth as (select word, list(coalesce(id, 0) order by i) as ids from (select word, i, substring('^' || {spelled} || '$', i::int + 1, 1) as ch from src, range({places + 1}) as r(i)) left join letter using (ch) group by word),
dec as (select word, 0 as n, 0::double as total, h, c from ready
  union all select word, n + 1, total + case when ids[n + 2] = 0 then 0 else whole - logits[ids[n + 2] + 1] end, h, c from ({logs}))
select (count(*) * {places})::bigint as n, round(sum(total) / (count(*) * {places}), 3) as loss from dec where n = {places}"""
