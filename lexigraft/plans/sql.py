"""SQL forms of the derived inputs, as common table expressions by name."""

from __future__ import annotations

import re


def h(expr: str) -> str:
    return f"cast('0x'||substr(md5({expr}),1,7) as bigint)"


def s(expr: str) -> str:
    return f"cast({expr} as varchar)"


WORDS_OF = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"


def words_of(expr: str) -> str:
    return WORDS_OF.format(expr)


def fingerprint(x: str = "x", d: str = "d") -> str:
    return (
        f"round(sum({x}),6) + 0.0::double as v_sum, round(sum({x}*({d}+1)),5) + 0.0::double as v_wsum, "
        f"round(sqrt(sum({x}*{x})),6) as v_norm"
    )


N = "(select count(*) from embeddings)"
_TAG = (
    f"case {h('w')} % 10 when 0 then 'B-PER' when 1 then 'I-PER' when 2 then 'I-LOC' "
    "when 3 then 'BO' when 4 then 'B-DATe' else 'O' end"
)
_KNOWN = "(t = 'O' or starts_with(t,'B-') or starts_with(t,'I-'))"

CTES: dict[str, str] = {
    "tok": f"""select doc_id, lang, unnest(ws) as w, unnest(range(len(ws))) as pos
        from (select doc_id, lang, {words_of('text')} as ws from documents)""",
    "line": """select * from (select doc_id, lang, unnest(range(len(ls))) as line_no, trim(unnest(ls)) as line
        from (select doc_id, lang, string_split(text, chr(10)) as ls from documents)) where line <> ''""",
    "ltok": f"""select doc_id, lang, line_no, unnest(ws) as w, unnest(range(len(ws))) as pos
        from (select doc_id, lang, line_no, {words_of('line')} as ws from line)""",
    "words": "select w, count(*) as n from tok group by w",
    "oldv": """select w, n, row_number() over (order by n desc, w) - 1 as id
        from (select w, count(*) as n from tok where lang = 'en' group by w)""",
    "vocab": "select case when id % 3 = 0 then '▁'||w else w end as token, w, n, id from oldv",
    "req": "select distinct w as token from tok where lang <> 'en'",
    "fresh": """select token, (select max(id)+1 from vocab) + row_number() over (order by token) - 1 as id
        from req where token not in (select token from vocab)""",
    "expanded": """select token, id, false as added from vocab union all select token, id, true from fresh""",
    "wvec": f"select w, {h('w')} % {N} as slot from words where {h(chr(39)+'c'+chr(39)+'||w')} % 10 <> 0",
    "vecd": """select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as d from embeddings""",
    "mrow": f"select id, w, {h(chr(39)+'r'+chr(39)+'||w')} % {N} as slot from oldv",
    "wmat": """select i, j, ((7*i + 3*j) % 11 - 5) / 16.0::double as x from range(64) a(i), range(64) b(j)""",
    "lexline": f"""select 10*{h("'l'||w")} as line_no,
          case {h("'s'||w")} % 5
            when 0 then n||' '||w||' '||pre||'- '||root||' -'||suf
            when 1 then n||' '||w||' - '||root||' -'||suf
            when 2 then w||' '||pre||'- '||root||' -'||suf
            when 3 then w||' '||pre||' '||root||' '||suf
            else n||' '||w||' '||root end as value from parts
        union all select 10*{h("'l'||w")} + 5, w||' '||root||' '||suf from parts where {h("'d'||w")} % 20 = 0
        union all select 0, unnest(['$'||lang||':', '# rows of '||lang, 'no |word|prefix|root '||lang, '  '])
          from (select distinct lang from documents)""",
    "parts": f"""select w, cast({h("'n'||w")} % 1000 as varchar) as n, substr(w,1,2) as pre,
          substr(w,3,length(w)-4) as root, substr(w,length(w)-1,2) as suf from words where length(w) >= 6""",
    "lexparse": f"""select line_no, f[1] as word,
          list_filter(list_transform(f[2:], lambda m: trim(m,'-')), lambda m: m <> '') as morphemes
        from (select line_no, case when regexp_full_match(f0[1],'[0-9]+') then f0[2:] else f0 end as f
          from (select line_no, {words_of('value')} as f0 from lexline
            where trim(value) <> '' and not starts_with(trim(value),'#') and not starts_with(trim(value),'$')
              and not contains(value,'|'))) where len(f) > 0""",
    "lex": """select word, arg_max(morphemes, line_no) as morphemes, count(*) as n_lines from lexparse
        where len(morphemes) > 0 group by word""",
    "seg": """select w, coalesce(a.morphemes, b.morphemes, []::varchar[]) as morphemes,
          case when a.word is not null then 'exact' when b.word is not null then 'lower' else 'none' end as how
        from words left join lex a on a.word = w left join lex b on b.word = lower(w)""",
    "mhit": """select s.w, v.slot from (select w, unnest(morphemes) as m from seg) s join wvec v on v.w = s.m""",
    "mmean": """select w, d, avg(x) as x from mhit join vecd on vec_id = slot group by w, d""",
    "stage": """select s.w, m.w is not null as has_m, v.slot,
          case when m.w is not null then 'morpheme' when v.w is not null then 'whole_token' else 'char_ngram' end as origin
        from words s left join (select distinct w from mhit) m on m.w = s.w left join wvec v on v.w = s.w""",
    "gram": """select w, substr(b, i, k) as g from (select w, '<'||w||'>' as b, k, unnest(range(1, length(w)+4-k)) as i
        from words, range(3,6) r(k))""",
    "gramv": f"""select w, d, avg(x) as x from (select g.w, {h("'g'||g")} % {N} as slot
        from gram g join stage s on s.w = g.w where s.origin = 'char_ngram') join vecd on vec_id = slot group by w, d""",
    "initv": """select w, 'morpheme' as origin, d, x from mmean
        union all select w, origin, d, x from stage join vecd on vec_id = slot where origin = 'whole_token'
        union all select w, 'char_ngram', d, x from gramv""",
    "snap": """select vec_id as id, d, x, x + case when vec_id % 7 = 0 then 0.5 else 0.0 end as y from vecd""",
    "anchor": "select o.id, o.token, o.w, v.slot as xs, m.slot as ys from (select id, token, w from vocab where length(w) >= 2) o "
        "join wvec v on v.w = o.w join mrow m on m.id = o.id",
    "unit": """select vec_id, list(x/(l+1e-8) order by d) as u from (select vec_id, d, x, sqrt(sum(x*x) over (partition by vec_id)) as l
        from vecd) group by vec_id""",
    "aux": "select o.id, v.slot, row_number() over (partition by v.slot order by o.id) as nth from oldv o join wvec v on v.w = o.w",
    "newq": "select f.id, f.token, v.slot from fresh f left join wvec v on v.w = f.token",
    "near": """select qslot, id, score, rank from (select q.vec_id as qslot, a.id, round(list_inner_product(q.u, r.u),9) as score,
            row_number() over (partition by q.vec_id order by round(list_inner_product(q.u, r.u),9) desc, a.id) as rank
          from unit q cross join aux a join unit r on r.vec_id = a.slot where a.nth <= 10) where rank <= 10""",
    "nearw": """select qslot, id, score, rank, exp(score - max(score) over (partition by qslot))
          / sum(exp(score)) over (partition by qslot) * exp(max(score) over (partition by qslot)) as weight from near""",
    "mixd": """select qslot, d, sum(weight*x) as x from nearw n join mrow m on m.id = n.id join vecd on vec_id = m.slot group by qslot, d""",
    "meand": "select d, avg(x) as x from mrow join vecd on vec_id = slot group by d",
    # tagged sentences
    "tagged": f"select doc_id, lang, line_no, pos, w, {_TAG} as raw from ltok",
    "gold": f"""select *, case when {_KNOWN} then t else 'O' end as tag from
        (select *, case when raw = 'B-DATe' then 'B-DATE' else raw end as t from tagged)""",
    "pred": f"""select doc_id, lang, line_no, pos, w, case when {h("'p'||w")} % 8 = 0 then 'O' else tag end as tag from gold""",
    "typed": """select 'g' as side, doc_id, line_no, pos, tag, case when starts_with(tag,'B-') or starts_with(tag,'I-') then substr(tag,3) end as et from gold
        union all select 'p', doc_id, line_no, pos, tag, case when starts_with(tag,'B-') or starts_with(tag,'I-') then substr(tag,3) end from pred""",
    "bounds": """select *, sum(b) over (partition by side, doc_id, line_no order by pos) as grp from (select *,
          case when starts_with(tag,'I-') and et = lag(et) over (partition by side, doc_id, line_no order by pos) then 0 else 1 end as b from typed)""",
    "span": """select side, doc_id, line_no, any_value(et) as etype, min(pos) as s, max(pos)+1 as e from bounds
        where et is not null group by side, doc_id, line_no, grp""",
    # questions
    "q": f"""select *, case when cls < 5 then [{{'text': a_text, 'start': a_start}}]
            when cls = 5 then [{{'text': a_text, 'start': a_start}}, {{'text': a_text||'~', 'start': a_start}}]
            when cls = 6 then [{{'text': a_text, 'start': a_start+1}}]
            when cls <= 8 then [{{'text': a_text||'~', 'start': -1}}] end as answers
        from (select *, substr(context, a_start+1, 12) as a_text from (
          select 'q'||doc_id as id, doc_id, lang as title, text as context,
            'where is '||repeat('really ', {h("'z'||"+s('doc_id'))} % 8)||source as question,
            {h("'q'||"+s('doc_id'))} % 10 as cls, {h(s('doc_id'))} % greatest(length(text)-20, 1) as a_start from documents))""",
    "qans": "select id, doc_id, context, i as ans_no, answers[i]['text'] as t, answers[i]['start'] as s from (select *, unnest(range(1, len(answers)+1)) as i from q)",
    "qvalid": "select *, (s >= 0 and substr(context, s+1, length(t)) = t) as ok from qans",
    "qclass": """select q.id, q.doc_id, q.title, q.context, q.answers, case when q.answers is null then 'unanswerable' when v.ok then 'extractive' else 'abstractive' end as class
        from q left join (select id, bool_or(ok) as ok from qvalid group by id) v on v.id = q.id""",
    "packed": """select conv_id, turn, role, reply,
          array_to_string(list_transform(string_split(text,'. '), lambda s, i: i||(case when i % 2 = 0 then ') ' else '. ' end)||s), ' ') as qc,
          array_to_string(list_transform(string_split(reply,'. '), lambda s, i: i||(case when i % 2 = 0 then ') ' else '. ' end)||s), ' ') as ac
        from (select a.conv_id, a.turn, a.role, a.text, b.text as reply from conversations a join conversations b
          on b.conv_id = a.conv_id and b.turn = a.turn + 1)""",
    "pieces": r"""select conv_id, turn, role, reply, 'q' as kind, list_filter(string_split(regexp_replace(regexp_replace(qc,
            '(^|[^0-9\x01])([0-9]+\s*[.)])', '\1'||chr(1)||'\2', 'g'), '(^|[^0-9\x01])([0-9]+\s*[.)])', '\1'||chr(1)||'\2', 'g'), chr(1)), lambda p: trim(p, ' '||chr(10)) <> '') as ps from packed
        union all select conv_id, turn, role, reply, 'a', list_filter(string_split(regexp_replace(regexp_replace(ac,
            '(^|[^0-9\x01])([0-9]+\s*[.)])', '\1'||chr(1)||'\2', 'g'), '(^|[^0-9\x01])([0-9]+\s*[.)])', '\1'||chr(1)||'\2', 'g'), chr(1)), lambda p: trim(p, ' '||chr(10)) <> '') from packed""",
    "stripped": r"""select conv_id, turn, reply, kind, ps, list_transform(ps, lambda p: trim(regexp_replace(p, '^[0-9]+\s*[.)]\s*', ''), ' '||chr(10))) as ss from pieces""",
    "triple": """select q.conv_id, q.turn, i-1 as pos, q.reply as context, q.ss[i] as question, a.ss[i] as answer
        from (select *, unnest(range(1, len(ss)+1)) as i from stripped where kind = 'q') q
        join stripped a on a.kind = 'a' and a.conv_id = q.conv_id and a.turn = q.turn and i <= len(a.ss)
        where q.ss[i] <> '' and a.ss[i] <> '' and q.reply <> ''""",
    # windows
    "off": r"""select doc_id, pos, s, s + length(w) as e from (select doc_id, pos, w,
          cast(sum(length(w) + length(g)) over (partition by doc_id order by pos) - length(w) as bigint) as s
        from (select doc_id, unnest(ws) as w, unnest(gs[:len(ws)]) as g, unnest(range(len(ws))) as pos from
          (select doc_id, list_filter(string_split_regex(text,'\s+'), lambda x: x <> '') as ws, string_split_regex(text,'[^\s]+') as gs from documents)))""",
    "cap": f"""select id, doc_id, ql, 384 - 4 - ql as c, n, case when n <= 384 - 4 - ql then 1
          else 1 + cast(ceil((n - (384-4-ql)) / (384-4-ql-128)::double) as bigint) end as k
        from (select id, doc_id, len({words_of('question')}) as ql, len({words_of('context')}) as n from q)""",
    "win": """select id, doc_id, ql, c, w as win, w*(c-128) as f, least(c, n - w*(c-128)) as wl
        from (select *, unnest(range(k)) as w from cap)""",
    "wtok": "select w.id, w.doc_id, w.win, w.ql, w.f, o.pos - w.f as k, o.s, o.e from win w join off o on o.doc_id = w.doc_id and o.pos >= w.f and o.pos < w.f + w.wl",
    "wlabel": """select id, win, ql, min(s) <= min(a0) and max(e) >= min(a1) as inside,
          max(case when s <= a0 then k end) as sk, min(case when e >= a1 then k end) as ek
        from (select t.*, q.a_start as a0, q.a_start + length(q.a_text) as a1 from wtok t join q on q.id = t.id) group by id, win, ql""",
    "score": f"""select id, doc_id, win, ql, wl, p,
          {h("'s'||"+s('doc_id')+"||'-'||"+s('win')+"||'-'||"+s('p'))} % 1000 / 10.0::double as ss,
          {h("'e'||"+s('doc_id')+"||'-'||"+s('win')+"||'-'||"+s('p'))} % 1000 / 10.0::double as es
        from (select *, unnest(range(ql + 3 + wl + 1)) as p from win)""",
    "sbest": "select * from (select *, row_number() over (partition by id, win order by ss desc, p) as r from score) where r <= 20",
    "ebest": "select * from (select *, row_number() over (partition by id, win order by es desc, p) as r from score) where r <= 20",
    "cand": """select a.id, a.doc_id, a.win, a.ql, a.p as sp, b.p as ep, a.r as sr, b.r as er, a.ss + b.es as sc
        from sbest a join ebest b on b.id = a.id and b.win = a.win
        where b.p >= a.p and b.p - a.p + 1 <= 64 and a.p >= a.ql + 3 and a.p < a.ql + 3 + a.wl and b.p >= b.ql + 3 and b.p < b.ql + 3 + b.wl""",
    "wbest": "select * from (select *, row_number() over (partition by id, win order by sc desc, sr, er) as r from cand) where r = 1",
    "ebest1": "select * from (select *, row_number() over (partition by id order by sc desc, win, sr, er) as rr from wbest) where rr = 1",
    "answer": """select q.id, q.answers, coalesce(substr(q.context, a.s+1, b.e - a.s), '') as prediction from q left join
        (select x.id, x.sc, o.s, x.doc_id, x.win, x.ep, x.ql from ebest1 x join wtok o on o.id = x.id and o.win = x.win and o.k = x.sp - x.ql - 3) a on a.id = q.id
        left join (select x.id, o.e from ebest1 x join wtok o on o.id = x.id and o.win = x.win and o.k = x.ep - x.ql - 3) b on b.id = q.id""",
    "pairq": "select id, prediction, unnest(list_transform(answers, lambda a: a['text'])) as gold, unnest(range(len(answers))) as g_no from answer where answers is not null",
    "ptok": f"""select id, g_no, t, count(*) as c from (select id, g_no, unnest({words_of('prediction')}) as t from pairq) group by all""",
    "gtok": f"""select id, g_no, t, count(*) as c from (select id, g_no, unnest({words_of('gold')}) as t from pairq) group by all""",
    "pairf": f"""select id, g_no, case when np = 0 and ng = 0 then 1.0 when np = 0 or ng = 0 or ov = 0 then 0.0
          else 2.0 * (ov/np::double) * (ov/ng::double) / (ov/np::double + ov/ng::double) end as f1, em, ov
        from (select p.id, p.g_no, len({words_of('prediction')}) as np, len({words_of('gold')}) as ng,
          coalesce(o.ov, 0) as ov, case when trim(prediction, ' '||chr(10)) = trim(gold, ' '||chr(10)) then 1.0 else 0.0 end as em
          from pairq p left join (select a.id, a.g_no, cast(sum(least(a.c, b.c)) as bigint) as ov from ptok a join gtok b
            on a.id = b.id and a.g_no = b.g_no and a.t = b.t group by all) o on o.id = p.id and o.g_no = p.g_no)""",
    "qscore": "select id, max(f1) as f1, max(em) as em from pairf group by id",
    # runs
    "run": f"""select event_id, value as f1, user_id, ['xlmr','lapt','random_lapt','focus_lapt','lexical_lapt'][user_id % 5 + 1] as system,
          user_id % 5 as ord, case event_id % 2 when 0 then 'ner' else 'qa' end as task,
          case (event_id // 2) % 2 when 0 then 'amharic' else 'tigrinya' end as language, 42 + event_id % 5 as seed,
          user_id % 5 >= 3 as has_proj, {h("'a'||"+s('event_id'))} % 3 <> 0 as supplied, event_id % 10 <> 0 as has_prov,
          md5('commit'||(user_id % 3)) as commit, md5('cfg'||(event_id % 2)) as config, {h("'d'||"+s('event_id'))} % 97 = 0 as dirty,
          {h("'m'||"+s('event_id'))} % 4 as dm, event_id % 4 as unavailable from events""",
    "req3": f"""select event_id as run_id, system, ord, {h("'req'||" + s('event_id'))} % 12 as b from run""",
    "named": "select *, system||'__'||task||'__'||language||'__seed'||seed as run_name, system||'__'||task||'__'||language||'__seed'||seed||'__run'||lpad(event_id::varchar, 12, '0') as experiment from run",
    "fid": """select language, task, system, case when count(*) filter (has_proj) = 0 then 'n/a -- no alignment matrix required'
          when bool_and(supplied) filter (has_proj) then 'author-supplied W' when bool_or(supplied) filter (has_proj) then '**MIXED -- some runs had no author-supplied W**'
          else '**not faithful -- no author-supplied W**' end as fidelity from run group by all""",
    "dstat": """select language, task, count(*) as n_runs, count(*) filter (dm >= 2) as n_documented, arg_min(dm, experiment) filter (dm >= 2) as dm
        from named where has_prov group by all""",
    "dstatus": """select language, task, n_runs, n_documented, case when n_documented = 0 then 'none' when n_documented < n_runs then 'some' else 'all' end as status,
          case when n_documented = 0 then '**manifest unavailable -- splits not traceable**' else 'src-'||language
            ||(case when dm = 2 then ' -- random 80/10/10' else '' end)||(case when dm = 3 then ' (split seed 42)' else '' end)
            ||(case when n_documented < n_runs then ' -- **'||(n_runs-n_documented)||' of '||n_runs||' runs had no manifest**' else '' end) end as detail from dstat""",
    "rtable": """select r.language, r.task, ord, ['XLM-R','+LAPT','+Random+LAPT','+FOCUS+LAPT','+Lexical+LAPT'][ord+1] as label,
          printf('%.2f', avg(f1))||' ± '||printf('%.2f', stddev_pop(f1)) as score, count(*) as seeds, any_value(fidelity) as fidelity
        from run r join fid f on f.language = r.language and f.task = r.task and f.system = r.system group by r.language, r.task, ord""",
    # exact seeded order and split over lines
    "lkey": r"""select doc_id, lang, line_no, line, md5('42|'||doc_id||chr(31)||line_no)||'|'||doc_id||chr(31)||line_no as k from line""",
    "lrank": "select *, row_number() over (order by k) - 1 as r, count(*) over () as n from lkey",
    "lsplit": """select *, case when r < floor(n*0.8::double) then 'train' when r < floor(n*0.8::double) + floor(n*0.1::double) then 'dev' else 'test' end as split from lrank""",
}


_TABLE = re.compile(r"\b(?:from|join)\s+([a-z_][a-z_0-9]*)")


def sql(body: str) -> str:
    """``body`` preceded by the inputs it reads, each after those it reads itself."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _TABLE.findall(text):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                ordered.append(name)

    visit(body)
    heads = ", ".join(f"{name} as ({CTES[name]})" for name in ordered)
    return f"with {heads} {body}" if heads else body
