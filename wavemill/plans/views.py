"""Catalogue and log views over the given tables. The text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MMSS = "concat(lpad(cast(cast(floor({0}/60.0) as bigint) as varchar(20)),2,'0'),':',lpad(cast({0}%60 as varchar(20)),2,'0'))"
_MS = "concat(cast(cast(floor({0}/60.0) as bigint) as varchar(20)),'m',cast({0}%60 as varchar(20)),'s')"
_A, _B = "((event_id*37)%3000)", "((event_id*37)%3000 + 1 + (event_id*11)%1000)"

FEEDS = "select p_partkey as id, p_name as title, p_brand as author, cast(p_size as bigint) as last_update_time, p_partkey as pos from {part}"

#: doc_id orders a feed's episodes as the service would.
EPISODES = """select d.doc_id as id, cast(substr(d.source,4) as bigint) as feed_id, d.source as feed_title,
  replace(substr(d.text,1,60),chr(10),' ') as title, d.text as description, d.lang as author, p.url as enclosure_url, d.doc_id as pos
from {documents} d left join {pages} p on p.page_id = d.doc_id"""

SEARCHES = """select conv_id as request_id, lower(substr(text,1,cast(3+conv_id%3 as int))) as q, 1+conv_id%3 as page, conv_id%20 as feed_id
from {conversations} where role='user' and turn<=1"""

CLIP_REQUESTS = f"""select event_id as request_id, user_id, event_id % 1200 as episode_id,
  case event_id % 8
    when 0 then concat({_MMSS.format(_A)},'-',{_MMSS.format(_B)})
    when 1 then concat(cast({_A} as varchar(20)),'-',cast({_B} as varchar(20)))
    when 2 then concat({_MS.format(_A)},'-',{_MS.format(_B)})
    when 3 then concat('00:',{_MMSS.format(_A)},'-01:',{_MMSS.format(_A)})
    when 4 then concat({_MMSS.format(_B)},'-',{_MMSS.format(_A)})
    when 5 then concat({_MMSS.format(_A)},'-soon')
    when 6 then {_MMSS.format(_A)}
    else concat(' ',{_MMSS.format(_A)},' - ',{_MMSS.format(_B)},' ') end as interval_text
from {{events}} where event_type='purchase'"""

SEGMENTS = "select conv_id as episode_id, turn, turn*60 as seg_start, turn*60+60 as seg_end, text from {conversations}"

UPDATES = """select event_id as update_id, user_id, ts,
  case event_type
    when 'signup'   then case when event_id%2=0 then 'cut' else 'search' end
    when 'view'     then 'text_many'
    when 'click'    then 'id'
    when 'purchase' then 'interval_ok'
    else case when event_id%3=0 then 'cancel' else 'text_none' end end as symbol
from {events}"""

RAW_UPDATES = """select event_id as update_id, user_id,
  case when event_type='click' then 'callback' else 'text' end as kind,
  case when event_type='click' then case event_id%3 when 0 then 'next_page' when 1 then 'prev_page' else cast(event_id as varchar(20)) end
    else case event_id%9 when 0 then 'Trending Podcasts' when 1 then '/cut_podcast' when 2 then 'Surprise Me' when 3 then '/cancel' when 4 then 'Help'
      when 5 then '/trending now' when 6 then 'Search Episodes Globally' when 7 then '/unknown' else concat('text ', event_type) end end as payload
from {events}"""

#: A search of all fields for each conversation: parts of what was said, names of sources, languages.
PERSON_REQUESTS = """select conv_id as request_id, case conv_id%4 when 0 then concat('Src',cast(conv_id%20 as varchar(20))) when 1 then substr(text,2,9) when 2 then substr(text,5,7) else 'nothing' end as q
from {conversations} where role='user' and turn<=1"""

PAGE_REQUESTS = """select conv_id as request_id, case conv_id%5 when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' else 'view' end as event_type,
  case when conv_id%9<3 then conv_id%9-1 else (conv_id%9)*(conv_id%50) end as page from {conversations} where role='user' and turn<=1"""

#: Feeds with titles of their own, so that a search can find one, many or none.
SHOWS = "select p_partkey as id, concat(p_name,' #',cast(p_partkey as varchar(20)),'.') as title, p_brand as author from {part}"

#: Chat updates as they come: buttons, commands, searches, titles, ids of feeds and episodes, intervals.
RAW_LOG = """select e.event_id as update_id, e.user_id, case when e.event_type='click' then 'callback' else 'text' end as kind,
  case when e.event_type='click' then
    case e.event_id%11 when 0 then 'next_page' when 1 then 'next_page' when 2 then 'prev_page' when 3 then 'none' when 4 then cast(e.event_id%23 as varchar(20)) when 5 then cast(e.event_id%23 as varchar(20))
      when 6 then cast(e.event_id%17 as varchar(20)) else cast((e.event_id*7)%300 as varchar(20)) end
  else case e.event_id%23 when 0 then '/cut_podcast' when 1 then 'Search Episodes Globally' when 2 then '/trending' when 3 then 'Surprise Me' when 4 then 'Search Podcast by Name'
    when 5 then 'Help' when 6 then case when e.event_id%2=0 then '/cancel' else '/start' end when 7 then concat('#',cast(e.event_id%25 as varchar(20)),'.') when 8 then concat('#',cast(e.event_id%19 as varchar(20)),'.')
    when 9 then concat(cast(e.event_id%10 as varchar(20)),'.') when 10 then lower(substr(d.text,1,cast(9+e.event_id%5 as int))) when 11 then substr(d.text,14,9) when 12 then 'nothing like it' when 13 then lower(substr(d.text,2,10))
    when 14 then '/cut_podcast' when 15 then '/trending' when 16 then 'Surprise Me' when 17 then lower(substr(d.text,1,9)) when 18 then '00:10-02:00' when 19 then '90-30' when 20 then '5-2000' when 21 then '1m-1m30s' else '0-x' end end as payload
from {events} e left join {documents} d on d.doc_id = (e.event_id*13)%200"""

RAW = ("part", "documents", "pages", "conversations", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in RAW if "{" + name + "}" in text})


def sql(text: str) -> str:
    """The view as a subquery for DuckDB."""
    return "(" + text.format(**{name: name for name in RAW}) + ")"
