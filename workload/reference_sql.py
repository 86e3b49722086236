"""DuckDB SQL for intermediate results that several reference queries share.

Written from the rules, independently of the DataFrame operators.
"""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(e: str) -> str:
    return f"regexp_replace({e}, '{WS}+$', '')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'), ' ')"


def optional(e: str) -> str:
    return f"nullif({strip(e)}, '')"


def keep_first(e: str) -> str:
    """Distinct items of a list in the order of their first appearance."""
    return f"list_filter({e}, lambda v, i: list_position({e}, v) = i)"


def filled(e: str) -> str:
    return f"list_filter({e}, lambda v: v IS NOT NULL AND v <> '')"


def clean_list(e: str, how=collapse) -> str:
    cleaned = filled(f"list_transform({e}, lambda v: {how('v')})")
    return keep_first(cleaned)


def split_clean(e: str, pattern: str) -> str:
    return filled(f"list_transform(regexp_split_to_array({e}, '{pattern}'), lambda v: {collapse('v')})")


def truncated(e: str, n: int) -> str:
    s = strip(e)
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE {rstrip(f'substring({s}, 1, {n})')} END"


def labelled(label: str, e: str) -> str:
    return f"CASE WHEN {e} IS NOT NULL AND {e} <> '' THEN '{label}：' || {e} END"


def labelled_list(label: str, e: str) -> str:
    return f"CASE WHEN len({e}) > 0 THEN '{label}：' || array_to_string({e}, '；') END"


# Title endings, written out so that the engine's own list is checked.
SUFFIX = "(经理|工程师|主管|专员|顾问|助理|组长|管理员|管理|代表|会计|出纳|监理|文秘)$"
TYPE_WEIGHT = (
    "CASE query_type WHEN 'target_job_title' THEN 0.4::DOUBLE WHEN 'work_experience' THEN 0.3::DOUBLE "
    "WHEN 'project_experience' THEN 0.18::DOUBLE WHEN 'skills' THEN 0.12::DOUBLE END"
)
SUPPORT_WEIGHT = (
    "CASE query_type WHEN 'work_experience' THEN 0.5::DOUBLE WHEN 'project_experience' THEN 0.3::DOUBLE "
    "ELSE 0.2::DOUBLE END"
)


def clamp(e: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"


def tokens(e: str) -> str:
    return f"list_filter(string_split(lower({collapse(e)}), ' '), lambda v: v <> '')"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({tokens(a)}, {tokens(b)}))"
    union = f"len(list_distinct(list_concat({tokens(a)}, {tokens(b)})))"
    return f"coalesce({common}::DOUBLE / nullif({union}, 0), 0.0)"


TABLES: dict[str, str] = {
    "o_intents": f"""
SELECT resume_id, target_job_title, is_empty,
  CASE WHEN is_empty THEN []::VARCHAR[] WHEN len(strong) > 1 THEN {keep_first('strong')}
    WHEN by_slash THEN {keep_first('slash')} ELSE [cleaned] END AS job_titles,
  NOT is_empty AND (len(strong) > 1 OR by_slash) AS is_multi_intent
FROM (
  SELECT *, coalesce(cleaned, '') = '' AS is_empty,
    len(slash) > 1 AND len(list_filter(slash, lambda v: NOT regexp_matches(v, '{SUFFIX}'))) = 0 AS by_slash
  FROM (
    SELECT *, {split_clean('cleaned', '[、，,；;|]+')} AS strong, {split_clean('cleaned', '[/／]+')} AS slash
    FROM (SELECT resume_id, target_job_title, {collapse('target_job_title')} AS cleaned FROM fx_intents)))""",
    "o_targets": """
SELECT resume_id, 'target_' || pos AS target_id, pos AS target_pos, requested_job_title FROM (
  SELECT resume_id, unnest(range(1, len(job_titles) + 1)) AS pos, unnest(job_titles) AS requested_job_title
  FROM o_intents)""",
    "o_titles": "SELECT job_title, count(*) AS n_jds, min(id) AS first_jd_id FROM fx_jd GROUP BY job_title",
    "o_match": """
SELECT t.*, coalesce(d.job_title, a.standard_title) AS normalized_title,
  CASE WHEN d.job_title IS NOT NULL THEN 'direct' WHEN a.standard_title IS NOT NULL THEN 'alias' END AS match_type,
  coalesce(d.n_jds, a.n_jds, 0) AS n_jds, coalesce(d.first_jd_id, a.first_jd_id) AS first_jd_id
FROM o_targets t LEFT JOIN o_titles d ON d.job_title = t.requested_job_title
LEFT JOIN (SELECT alias_title, standard_title, n_jds, first_jd_id FROM fx_alias
  JOIN o_titles ON o_titles.job_title = standard_title) a ON a.alias_title = t.requested_job_title""",
    "o_exact_cands": """
SELECT m.resume_id, m.target_id, m.requested_job_title, m.match_type, j.id AS jd_id, j.job_title, j.department,
  row_number() OVER (PARTITION BY m.resume_id, m.target_id ORDER BY j.id) AS candidate_rank
FROM o_match m JOIN fx_jd j ON j.job_title = m.normalized_title""",
    "o_state": """
SELECT resume_id, target_id, target_pos, requested_job_title, n_jds AS n_candidates,
  CASE WHEN n_jds = 1 THEN 'resolved' WHEN n_jds > 1 THEN 'needs_confirmation' ELSE 'no_candidate' END AS status,
  CASE WHEN n_jds > 0 THEN 'exact' END AS source, CASE WHEN n_jds = 1 THEN first_jd_id END AS selected_jd_id,
  CASE WHEN n_jds = 1 THEN 'unique_exact_match' END AS resolution_method,
  CASE WHEN n_jds > 1 THEN '同名岗位匹配到多个 JD，请人工选择' ELSE '' END AS warning
FROM o_match""",
    "o_judged": """
SELECT d.event_id, d.ts, d.resume_id, d.tid AS target_id, d.action, d.jd_id, d.reason,
  CASE WHEN d.tid = '' THEN 'blank_target_id' WHEN s.status IS NULL THEN 'unknown_target'
    WHEN s.status <> 'needs_confirmation' THEN 'target_not_pending'
    WHEN d.action = 'confirm' AND c.jd_id IS NULL THEN 'jd_not_a_candidate'
    WHEN d.action = 'reject' AND s.n_candidates = 0 THEN 'no_candidates_to_reject' END AS reason_code
FROM (SELECT *, trim(target_id) AS tid FROM fx_decisions) d
LEFT JOIN o_state s ON s.resume_id = d.resume_id AND s.target_id = d.tid
LEFT JOIN o_exact_cands c ON c.resume_id = d.resume_id AND c.target_id = d.tid AND c.jd_id = d.jd_id""",
    "o_fold": """
SELECT *, CASE WHEN ended AND last_success THEN 'succeeded' WHEN ended THEN 'failed' ELSE 'retry_pending' END AS status
FROM (
  SELECT resume_id, jd_id, max(n) AS attempts, bool_or(ends) AS ended, bool_or(ends AND succeeded) AS last_success,
    arg_max(ts, n) AS last_ts, arg_max(event_id, n) AS last_event_id
  FROM (SELECT *, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id, jd_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended_before
        FROM (SELECT *, succeeded OR NOT retryable OR n > 2 AS ends
              FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, jd_id ORDER BY ts, event_id) AS n FROM fx_attempts)))
  WHERE coalesce(ended_before, 0) = 0 GROUP BY resume_id, jd_id)""",
    "o_assess": """
SELECT doc_id AS report_id, k AS dim,
  CASE k WHEN 0 THEN 'education' WHEN 1 THEN 'major' WHEN 2 THEN 'experience' WHEN 3 THEN 'skills' ELSE 'responsibilities' END AS dimension,
  CASE k WHEN 2 THEN 30 WHEN 3 THEN 25 WHEN 4 THEN 25 ELSE 10 END AS weight,
  CASE WHEN (n_chars + 7 * k) % 23 = 0 THEN 'unknown' WHEN (n_chars + k) % 11 = 0 THEN 'not_applicable'
    WHEN (n_chars + k) % 3 = 0 THEN 'matched' WHEN (n_chars + k) % 3 = 1 THEN 'partially_matched' ELSE 'mismatched' END AS status,
  CASE WHEN doc_id % 21 = 0 THEN CASE WHEN k = 0 THEN 50.0 END
    WHEN (n_chars + 7 * k) % 23 = 0 OR (n_chars + k) % 11 = 0 THEN NULL
    WHEN (n_chars + k) % 3 = 0 THEN 80.0 + doc_id % 25 WHEN (n_chars + k) % 3 = 1 THEN 40.0 + doc_id % 40
    ELSE 0.0 + doc_id % 40 END::DOUBLE AS score,
  CASE WHEN (doc_id + k) % 8 = 0 THEN ['resume'] WHEN (doc_id + k) % 10 = 0 THEN []::VARCHAR[]
    ELSE ['jd', 'resume', 'jd'] END AS sources,
  (doc_id + k) % 2 AS n_missing
FROM documents, range(5) t(k)""",
    "o_weighted_reports": """
SELECT report_id, bool_or(status = 'unknown') AS has_unknown, count(score) AS scored_dimensions,
  CASE WHEN NOT bool_or(status = 'unknown') THEN sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) END
    AS weighted_score
FROM o_assess GROUP BY report_id""",
    "o_overall": """
SELECT report_id, weighted_score, CASE report_id % 6 WHEN 0 THEN NULL WHEN 1 THEN floor(coalesce(weighted_score, 50) * 10 + 0.5) / 10 + 0.5
  WHEN 2 THEN floor(coalesce(weighted_score, 50)) + 0.25 ELSE CASE WHEN weighted_score IS NOT NULL THEN floor(weighted_score * 10 + 0.5) / 10 END END AS overall_score
FROM o_weighted_reports""",
}


def recall_tables(p: str, queries: str, chunks: str = "fx_chunks", k: int = 30, top_n: int = 10,
                  hit_filter: str = "TRUE") -> dict[str, str]:
    """Recall chain over a table of embedded queries; names carry the prefix ``p``."""
    return {
        f"{p}hits": f"""
SELECT * FROM (
  SELECT q.resume_id, q.target_id, q.query_id, q.query_type, q.query_order, c.chunk_id, c.jd_id, c.chunk_type, c.distance,
    1 - c.distance AS similarity, row_number() OVER (PARTITION BY q.resume_id, q.target_id, q.query_id ORDER BY c.distance, c.chunk_id) AS chunk_rank
  FROM {queries} q JOIN (
    SELECT v.vkey, c.chunk_id, c.jd_id, c.chunk_type,
      round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS distance
    FROM (SELECT DISTINCT vkey, embedding FROM {queries}) v, {chunks} c
    WHERE c.is_embedding_target AND c.embedding IS NOT NULL) c ON c.vkey = q.vkey
  WHERE {hit_filter})
WHERE chunk_rank <= {k}""",
        f"{p}weights": f"""
SELECT *, normalized_type_weight * penalty AS effective_type_weight,
  normalized_type_weight * penalty * weight / sum(weight) OVER (PARTITION BY resume_id, target_id, query_type) AS effective_weight
FROM (
  SELECT q.resume_id, q.target_id, q.query_id, q.query_type, q.query_order, q.weight, a.active_types,
    a.n_queries, {TYPE_WEIGHT} / a.active_sum AS normalized_type_weight,
    count(*) OVER (PARTITION BY q.resume_id, q.target_id, q.query_type) AS n_queries_of_type,
    CASE a.active_types WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.9::DOUBLE WHEN 4 THEN 1.0::DOUBLE END AS penalty
  FROM {queries} q JOIN (
    SELECT resume_id, target_id, count(*) AS active_types, sum({TYPE_WEIGHT}) AS active_sum, sum(n) AS n_queries
    FROM (SELECT resume_id, target_id, query_type, count(*) AS n FROM {queries} GROUP BY ALL) GROUP BY ALL) a
  ON a.resume_id = q.resume_id AND a.target_id = q.target_id)""",
        f"{p}best": f"""
SELECT resume_id, target_id, query_id, jd_id, min(chunk_rank) AS chunk_rank, arg_min(chunk_id, chunk_rank) AS chunk_id,
  arg_min(similarity, chunk_rank) AS similarity, count(*) AS chunk_hits
FROM {p}hits GROUP BY ALL""",
        f"{p}evid": f"""
SELECT b.*, w.query_type, w.query_order, w.penalty, w.n_queries, w.effective_weight,
  b.similarity * w.effective_weight AS weighted_similarity
FROM {p}best b JOIN {p}weights w USING (resume_id, target_id, query_id)""",
        f"{p}cands": f"""
SELECT resume_id, target_id, jd_id, max(CASE WHEN query_type = 'target_job_title' THEN similarity END) AS title_query_similarity,
  max(similarity) AS best_similarity, sum(weighted_similarity) AS evidence_score,
  {clamp('sum(effective_weight) / any_value(penalty)')} AS weighted_query_coverage,
  0.75::DOUBLE * max(similarity) + 0.25::DOUBLE * sum(weighted_similarity) AS aggregate_score,
  any_value(n_queries) AS total_query_count, count(*) AS matched_query_count, sum(chunk_hits) AS chunk_hit_count,
  min(query_order * 1000000 + chunk_rank) AS first_seen
FROM {p}evid GROUP BY resume_id, target_id, jd_id""",
        f"{p}recalled": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, target_id ORDER BY round(aggregate_score, 12) DESC,
    round(title_query_similarity, 12) DESC NULLS LAST, round(weighted_query_coverage, 12) DESC,
    round(best_similarity, 12) DESC, first_seen, jd_id) AS recall_rank FROM {p}cands)
WHERE recall_rank <= {top_n}""",
    }


_HEADER = "'公司岗位名称：' || j.job_title || CASE WHEN j.department IS NOT NULL THEN chr(10) || '所属部门：' || j.department ELSE '' END"

# Passages of fx_jd: its lines are short, so every section is one passage.
TABLES["o_docs"] = f"SELECT j.id AS jd_id, j.job_title, j.department, {_HEADER} AS header, j.* EXCLUDE (id, job_title, department) FROM fx_jd j"
TABLES["o_passages"] = f"""
SELECT jd_id, 0 AS passage_pos, 'qualification_part_0' AS section, header || chr(10) || array_to_string(list_filter([
    '最低学历：' || minimum_education, '专业背景：' || education_background,
    CASE WHEN trim(work_experience_raw) <> '' THEN '工作经验要求：' || work_experience_raw END], lambda v: v IS NOT NULL), chr(10)) AS text
FROM o_docs
UNION ALL
SELECT jd_id, 1, 'responsibility_0_part_0', header || chr(10) || '岗位职责：' || duty_1 || chr(10) || '具体任务：' || duty_2 FROM o_docs
UNION ALL
SELECT jd_id, 2, 'competency_part_0', header || chr(10) || array_to_string(list_transform({clean_list('[skill_1, skill_2, skill_1]')}, lambda v: '胜任能力：' || v), chr(10))
FROM o_docs"""
_PRIORITY = """CASE query_type
  WHEN 'work_experience' THEN CASE passage_pos WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END
  WHEN 'project_experience' THEN CASE passage_pos WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END
  ELSE CASE passage_pos WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END END"""


def rerank_tables(p: str, queries: str) -> dict[str, str]:
    """Rerank chain over ``{p}recalled`` and a table of queries with evidence text and requested title."""
    return {
        f"{p}titles": f"SELECT DISTINCT resume_id, target_id, requested_job_title FROM {queries}",
        f"{p}title_pairs": f"""
SELECT r.resume_id, r.target_id, r.jd_id, '申请岗位：' || t.requested_job_title AS left_text, d.header AS right_text
FROM {p}recalled r JOIN {p}titles t USING (resume_id, target_id) JOIN o_docs d ON d.jd_id = r.jd_id""",
        f"{p}support_pairs": f"""
SELECT r.resume_id, r.target_id, r.jd_id, q.query_id, q.query_type, q.query_order, q.resume_evidence_text AS left_text,
  {_PRIORITY} AS passage_pos, s.section, s.text AS right_text
FROM {p}recalled r JOIN {queries} q USING (resume_id, target_id) JOIN o_passages s ON s.jd_id = r.jd_id
WHERE q.query_type <> 'target_job_title'""",
        f"{p}title_scores": f"SELECT resume_id, target_id, jd_id, {jaccard('left_text', 'right_text')} AS title_similarity FROM {p}title_pairs",
        f"{p}scored": f"SELECT *, {jaccard('left_text', 'right_text')} AS score FROM {p}support_pairs",
        f"{p}best_passage": f"""
SELECT * EXCLUDE (r) FROM (SELECT resume_id, target_id, jd_id, query_id, query_type, query_order, passage_pos, section, score,
    row_number() OVER (PARTITION BY resume_id, target_id, jd_id, query_id ORDER BY score DESC, passage_pos) AS r FROM {p}scored)
WHERE r = 1""",
        f"{p}type_scores": f"""
SELECT *, w / sum(w) OVER (PARTITION BY resume_id, target_id, jd_id) AS normalized_weight,
  mean_best_score * w / sum(w) OVER (PARTITION BY resume_id, target_id, jd_id) AS weighted_contribution
FROM (SELECT resume_id, target_id, jd_id, query_type, count(*) AS query_count, avg(score) AS mean_best_score, {SUPPORT_WEIGHT} AS w
  FROM {p}best_passage GROUP BY ALL)""",
        f"{p}rcands": f"""
SELECT *, {clamp('0.6::DOUBLE * title_similarity + 0.3::DOUBLE * resume_support_score + 0.1::DOUBLE * recall_score')} AS resolution_score
FROM (SELECT r.*, d.job_title, d.department, t.title_similarity, {clamp('r.aggregate_score')} AS recall_score,
  {clamp('coalesce(s.total, 0.0::DOUBLE)')} AS resume_support_score
  FROM {p}recalled r JOIN o_docs d ON d.jd_id = r.jd_id JOIN {p}title_scores t ON t.resume_id = r.resume_id AND t.target_id = r.target_id AND t.jd_id = r.jd_id
  LEFT JOIN (SELECT resume_id, target_id, jd_id, sum(weighted_contribution) AS total FROM {p}type_scores GROUP BY ALL) s
  ON s.resume_id = r.resume_id AND s.target_id = r.target_id AND s.jd_id = r.jd_id)""",
        f"{p}ranked": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, target_id ORDER BY round(resolution_score, 12) DESC,
  round(title_similarity, 12) DESC, round(resume_support_score, 12) DESC, round(recall_score, 12) DESC, recall_rank) AS rerank_rank
  FROM {p}rcands) WHERE rerank_rank <= 5""",
        f"{p}decided": f"""
SELECT t.resume_id, t.target_id, t.requested_job_title, coalesce(r.n, 0) AS recall_count, coalesce(k.n, 0) AS reranked_count,
  coalesce(m.ids, '') AS missing_jd_ids, k.first_id AS recommended_jd_id, k.s1 - k.s2 AS top_margin, coalesce(k.listing, '') AS candidates,
  CASE WHEN coalesce(k.n, 0) = 0 THEN 'no_candidate' ELSE 'needs_confirmation' END AS status,
  array_to_string(list_filter([CASE WHEN m.ids IS NOT NULL AND k.n > 0 THEN '部分粗召回候选缺少完整JD: ' || m.ids END,
    CASE WHEN r.n IS NULL THEN '粗召回阶段没有产生候选JD' WHEN k.n IS NULL THEN '所有粗召回候选均缺少可用的完整JD'
      ELSE '语义兜底岗位默认需要人工确认' END], lambda v: v IS NOT NULL), '|') AS decision_warnings
FROM {p}titles t
LEFT JOIN (SELECT resume_id, target_id, count(*) AS n FROM {p}recalled GROUP BY ALL) r USING (resume_id, target_id)
LEFT JOIN (SELECT resume_id, target_id, string_agg(jd_id::VARCHAR, '、' ORDER BY recall_rank) AS ids FROM {p}recalled
  WHERE jd_id NOT IN (SELECT id FROM fx_jd) GROUP BY ALL) m USING (resume_id, target_id)
LEFT JOIN (SELECT resume_id, target_id, count(*) AS n, max(CASE WHEN rerank_rank = 1 THEN jd_id END) AS first_id,
    max(CASE WHEN rerank_rank = 1 THEN resolution_score END) AS s1, max(CASE WHEN rerank_rank = 2 THEN resolution_score END) AS s2,
    string_agg(jd_id::VARCHAR, ',' ORDER BY rerank_rank) AS listing FROM {p}ranked GROUP BY ALL) k USING (resume_id, target_id)""",
    }


TABLES["fx_vqueries"] = "SELECT *, query_id AS vkey FROM fx_queries"
TABLES |= recall_tables("q_", "fx_vqueries")
TABLES |= rerank_tables("q_", "fx_vqueries")

# ---- query units of the open targets --------------------------------------------------------------

_W1_RESP = clean_list("[p.a_duty_1, '  ', ' ' || p.a_duty_2 || ' ', p.a_duty_1]")
_W1_ACH = clean_list("CASE WHEN p.resume_id % 2 = 0 THEN ['handled  ' || p.b_title] ELSE []::VARCHAR[] END")
_SKILLS = clean_list("[p.a_skill_1, ' ' || p.a_skill_2 || '  ', p.b_skill_1, p.a_skill_1]")
_TECH = clean_list("[p.a_skill_1, p.b_skill_1, p.a_skill_1]")
_OPEN = "o_match t JOIN fx_people p ON p.resume_id = t.resume_id WHERE t.match_type IS NULL"


def _joined(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL), '；')"


def _unit(suffix: str, kind: str, label: str, evidence: str, order: str, index: str, where: str) -> str:
    return f"""
SELECT resume_id, target_id, target_pos, requested_job_title, target_id || ':{suffix}' AS query_id, '{kind}' AS query_type,
  {truncated(f"'申请岗位：' || requested_job_title || chr(10) || '{label}：' || evidence", 1500)} AS text,
  {truncated('evidence', 1500)} AS resume_evidence_text, {order} AS kind_order, {index} AS source_index
FROM (SELECT t.resume_id, t.target_id, t.target_pos, t.requested_job_title, {strip(evidence)} AS evidence FROM {_OPEN} AND {where})
WHERE length(evidence) >= 2"""


TABLES["u_title"] = f"""
SELECT t.resume_id, t.target_id, t.target_pos, t.requested_job_title, t.target_id || ':title' AS query_id, 'target_job_title' AS query_type,
  '申请岗位：' || t.requested_job_title AS text, NULL::VARCHAR AS resume_evidence_text, 0 AS kind_order, NULL::INT AS source_index
FROM {_OPEN}"""
TABLES["u_work"] = _unit(
    "work_0", "work_experience", "候选人工作经历",
    _joined(labelled("岗位", "p.o_orderpriority"), labelled("部门", "p.a_department"),
            labelled_list("工作职责", _W1_RESP), labelled_list("工作成果", _W1_ACH)), "1", "0", "p.n_work >= 1",
) + "\nUNION ALL" + _unit(
    "work_1", "work_experience", "候选人工作经历",
    _joined(labelled("岗位", "p.work_2_title"), labelled("部门", "p.c_mktsegment"), "'工作职责：' || p.b_duty_1"), "2", "1", "p.n_work = 2",
)
TABLES["u_project"] = _unit(
    "project_0", "project_experience", "候选人项目经历",
    _joined("'项目名称：' || p.a_skill_2 || ' rollout'", "'项目描述：' || p.b_duty_2", "'项目职责：' || p.a_duty_1",
            labelled_list("项目技术", _TECH)), "3", "0", "p.n_project = 1 AND NOT p.empty_project",
)
TABLES["u_skills"] = _unit(
    "skills", "skills", "候选人技能", labelled_list("技能与能力", _SKILLS), "4", "NULL::INT", "p.has_skills",
)
TABLES["u_all"] = """
SELECT *, row_number() OVER (PARTITION BY resume_id, target_id ORDER BY kind_order) - 1 AS query_order, 1.0::DOUBLE AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_id, target_id, text ORDER BY kind_order) AS copy FROM (
    SELECT * FROM u_title UNION ALL SELECT * FROM u_work UNION ALL SELECT * FROM u_project UNION ALL SELECT * FROM u_skills))
WHERE copy = 1"""
TABLES["u_warnings"] = """
SELECT t.resume_id, t.target_id, array_to_string(list_filter([
  CASE WHEN coalesce(w, 0) = 0 THEN '未构造出工作经历检索单元' END, CASE WHEN coalesce(p, 0) = 0 THEN '未构造出项目经历检索单元' END,
  CASE WHEN coalesce(s, 0) = 0 THEN '未构造出技能检索单元' END,
  CASE WHEN n = 1 THEN '简历缺少可用经历或技能，本次仅使用申请岗位名称召回' END], lambda v: v IS NOT NULL), '|') AS warnings
FROM u_title t LEFT JOIN (SELECT resume_id, target_id, count(*) AS n, count_if(query_type = 'work_experience') AS w,
  count_if(query_type = 'project_experience') AS p, count_if(query_type = 'skills') AS s FROM u_all GROUP BY ALL) USING (resume_id, target_id)"""
TABLES["u_embedded"] = """
SELECT u.*, e.vec_id AS vkey, e.embedding FROM u_all u
JOIN embeddings e ON e.vec_id = (u.resume_id * 7 + u.target_pos * 3 + u.query_order) % (SELECT count(*) FROM embeddings)"""
TABLES |= recall_tables("m_", "u_embedded")
TABLES |= rerank_tables("m_", "u_embedded")
