"""Element tables derived from the driver's tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as elements; (doc_id + line) mod 12 gives each its type and marker."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    k = (F.col("doc_id") + F.col("ord")) % 12
    rows = rows.withColumn("k", k.cast("int"))
    kind = F.when(F.col("ord") == 0, F.lit("TITLE")).otherwise(
        F.element_at(F.array(*map(F.lit, ["LIST_ITEM", "HEADING", "PARAGRAPH", "PARAGRAPH", "PARAGRAPH", "PARAGRAPH", "CODE", "SEPARATOR", "LOG_ENTRY", "LOG_ENTRY", "TABLE_CELL", "PARAGRAPH"])), F.col("k") + 1)
    )
    mark = F.element_at(F.array(*map(F.lit, ["", "1.2 ", "(a) ", "(b) ", "Question: ", "Answer: ", "", "", "10:30 ", "10:31 ", "", "Note: "])), F.col("k") + 1)
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"), "ord", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("element_id"), kind.alias("type"),
        F.when(F.col("ord") % 2 == 0, F.lit("EXPLICIT")).otherwise(F.lit("INFERRED")).alias("source"), F.concat(mark, F.when(F.col("k") == 0, F.concat(F.col("line"), F.lit(":"))).otherwise(F.col("line"))).alias("text"),
        F.when(kind == "HEADING", 1 + (F.col("doc_id") + F.col("ord")) % 3).cast("int").alias("heading_level"), (F.col("k") < 3).alias("bold"), (10 + F.col("k") % 3).cast("double").alias("font_size"), "k",
    )


LINES = """lines as (select doc_id, (i - 1)::int as ord, line, ((doc_id + i - 1) % 12)::int as k
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
el as (select doc_id::varchar as document_id, ord, doc_id || ':' || ord as element_id,
  case when ord = 0 then 'TITLE' else (['LIST_ITEM','HEADING','PARAGRAPH','PARAGRAPH','PARAGRAPH','PARAGRAPH','CODE','SEPARATOR','LOG_ENTRY','LOG_ENTRY','TABLE_CELL','PARAGRAPH'])[k + 1] end as type,
  case when ord % 2 = 0 then 'EXPLICIT' else 'INFERRED' end as source,
  (['','1.2 ','(a) ','(b) ','Question: ','Answer: ','','','10:30 ','10:31 ','','Note: '])[k + 1] || case when k = 0 then line || ':' else line end as text,
  case when ord > 0 and k = 1 then (1 + (doc_id + ord) % 3)::int end as heading_level, k < 3 as bold, (10 + k % 3)::double as font_size, k from lines)"""


def _with_patterns(sql: str) -> str:
    """SQL with the patterns and types of :mod:`signals`, as the other engine writes them: its classes are always Unicode, and a look-ahead is a group."""
    patterns = {"NUMBERING": signals.NUMBERING, "SECTION": signals.section_pattern(), "QUESTION": signals.QUESTION, "ANSWER": signals.ANSWER, "TIMESTAMP": signals.TIMESTAMP, "SPEAKER": signals.SPEAKER}
    for name, pattern in patterns.items():
        sql = sql.replace("{" + name + "}", "'" + pattern.replace("(?Ui)", "(?i)").replace("(?U)", "").replace("(?=", "(") + "'")
    return sql.replace("{LEXICAL}", ",".join(f"'{t}'" for t in signals.LEXICAL_TYPES))


#: Markers, boundaries and classes of neighbours, from el.
MARKS = LINES + _with_patterns(r""",
mk as (select *, type in ({LEXICAL}) as lex from el),
m1 as (select *,
  case when lex and regexp_matches(text, {NUMBERING}) then regexp_extract(text, {NUMBERING}, 1) end as numbering,
  case when lex and regexp_matches(text, {SECTION}) then regexp_extract(text, {SECTION}, 1) end as section,
  case when lex and regexp_matches(text, {QUESTION}) then regexp_extract(text, {QUESTION}, 1) end as question,
  case when lex and regexp_matches(text, {ANSWER}) then regexp_extract(text, {ANSWER}, 1) end as answer,
  case when lex and regexp_matches(text, {TIMESTAMP}) then 'T' end as stamp,
  lex and regexp_matches(text, {SPEAKER}) as says from mk),
m2 as (select *, says and question is null and answer is null and stamp is null and section is null as speaker from m1),
pr as (select *, lag(element_id) over w as l_id, lag(type) over w as lt, lag(question) over w as l_question, lag(bold) over w as l_bold, lag(font_size) over w as l_font from m2 window w as (partition by document_id order by ord)),
b0 as (select *, case when (lt = 'QUESTION' and type = 'ANSWER') or (l_question is not null and answer is not null) then 'QA_PAIR' end as guard,
  type in ('TITLE','HEADING') and source = 'EXPLICIT' as explicit, lt = 'SEPARATOR' or type = 'SEPARATOR' as separator,
  (lt in ('TABLE','TABLE_ROW','TABLE_CELL') and type in ('TABLE','TABLE_ROW','TABLE_CELL')) or (lt = 'CODE' and type = 'CODE') or (lt in ('LIST','LIST_ITEM') and type in ('LIST','LIST_ITEM')) as family,
  numbering is not null or section is not null or question is not null or stamp is not null or speaker as pattern_start, lt = 'PARAGRAPH' and type = 'PARAGRAPH' as paragraph_break,
  case when (lt in ('TABLE','TABLE_ROW','TABLE_CELL')) <> (type in ('TABLE','TABLE_ROW','TABLE_CELL')) then 'TABLE_BOUNDARY' when (lt = 'CODE') <> (type = 'CODE') then 'CODE_BOUNDARY' end as hard_reason
  from pr where l_id is not null),
b1 as (select *, lt <> type and not family as type_change, case when family then 0.0::double else ((l_bold <> bold)::int + (l_font <> font_size)::int) / 2.0::double end as style_change from b0),
b2 as (select *, 1.0::double * explicit::int + 0.25::double * style_change + 0.3::double * type_change::int + 1.0::double * separator::int + 0.45::double * pattern_start::int + 0.3::double * paragraph_break::int as score from b1),
bd as (select *, case when guard is not null then 'NONE' when explicit or separator or hard_reason is not null then 'HARD' when score = 0 and ((lt = 'UNKNOWN' and type = 'UNKNOWN') or family) then 'UNKNOWN'
  when score >= 0.8 then 'HARD' when score >= 0.25 then 'SOFT' else 'NONE' end as class from b2)""")


def turn_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as elements: users ask, assistants answer in every other conversation, all else are dialogue turns or separators."""
    rows = table(spark, sf_dir, "conversations")
    pairs = F.col("conv_id") % 2 == 0
    kind = F.when(F.col("role") == "system", F.lit("SEPARATOR")).when(pairs & (F.col("role") == "user"), F.lit("QUESTION")).when(pairs & (F.col("role") == "assistant"), F.lit("ANSWER")).otherwise(F.lit("DIALOGUE_TURN"))
    return rows.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("ord"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("element_id"), kind.alias("type"), F.lit("EXPLICIT").alias("source"), "text", "role")


TURNS = """tn as (select conv_id::varchar as document_id, turn::int as ord, conv_id || ':' || turn as element_id,
  case when role = 'system' then 'SEPARATOR' when conv_id % 2 = 0 and role = 'user' then 'QUESTION' when conv_id % 2 = 0 and role = 'assistant' then 'ANSWER' else 'DIALOGUE_TURN' end as type, text, role from conversations)"""


def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order as elements whose category is the event type's."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("element_id"), "event_type", "value", "ts")
