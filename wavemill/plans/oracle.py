"""The queries in DuckDB's SQL."""

from __future__ import annotations

from . import views

_V = {name: views.sql(getattr(views, name)) for name in ("FEEDS", "EPISODES", "SEARCHES", "CLIP_REQUESTS", "SEGMENTS", "UPDATES", "RAW_UPDATES", "SHOWS", "RAW_LOG", "PAGE_REQUESTS", "PERSON_REQUESTS")}
FEEDS, EPISODES, SEARCHES, CLIPS, SEGMENTS, UPDATES, RAW_UPDATES, SHOWS, RAW_LOG, PAGES, PERSONS = _V.values()


def _int(x: str) -> str:
    return f"(case when regexp_matches({x}, '^\\s*[+-]?[0-9]+\\s*$') then try_cast(regexp_replace({x}, '\\s', '', 'g') as bigint) end)"


def _seconds(t: str) -> str:
    t = f"lower(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'))"
    unit = [f"regexp_extract({t}, '^([0-9]+h)?\\s*([0-9]+m)?\\s*([0-9]+s)?', {i})" for i in (1, 2, 3)]
    value = [f"(case when {u} = '' then 0 else try_cast(rtrim({u}, 'hms') as bigint) end)" for u in unit]
    part = [_int(f"split_part({t}, ':', {i})") for i in (1, 2, 3)]
    colons = f"len(string_split({t}, ':'))"
    return (
        f"(case when regexp_matches({t}, '^[0-9]+$') then try_cast({t} as bigint)"
        f" when {unit[0]} <> '' or {unit[1]} <> '' or {unit[2]} <> '' then {value[0]} * 3600 + {value[1]} * 60 + {value[2]}"
        f" when {colons} = 2 then {part[0]} * 60 + {part[1]} when {colons} = 3 then {part[0]} * 3600 + {part[1]} * 60 + {part[2]} end)"
    )


_START = "case when strpos(interval_text, '-') > 0 then left(interval_text, strpos(interval_text, '-') - 1) else interval_text end"
_END = "case when strpos(interval_text, '-') > 0 then substr(interval_text, strpos(interval_text, '-') + 1) end"
PARSED = f"(select x.*, {_seconds('a')} as start_sec, {_seconds('b')} as end_sec from (select r.*, {_START} as a, {_END} as b from {CLIPS} r) x)"
_PARSE = "case when start_sec is null or end_sec is null then 'bad_interval' when start_sec >= end_sec then 'not_after' else 'ok' end"
VALID = f"""(select v.*, case when status = 'ok' then 'ok' when status in ('bad_interval', 'not_after') then 'retryable' else 'terminal' end as outcome from (
  select p.*, e.feed_title, e.title, case when e.enclosure_url is null then 'no_url' when start_sec is null or end_sec is null then 'bad_interval' when start_sec >= end_sec then 'not_after'
    when end_sec - start_sec > 900 then 'too_long' else 'ok' end as status
  from {PARSED} p left join {EPISODES} e on e.id = p.episode_id) v)"""
_CLIP = "request_id, user_id, episode_id, start_sec, end_sec, status, outcome"
_PARTS = "replace(coalesce(feed_title, 'Podcast'), ' ', '_') || '-' || replace(coalesce(title, 'Episode'), ' ', '_') || '-' || replace(replace(interval_text, ':', '-'), ' ', '')"
_NAME = f"replace(replace({_PARTS} || '.mp3', '/', '_'), chr(92), '_')"
MATCHES = f"(select r.request_id, r.page, e.id, e.feed_title, e.title, e.enclosure_url from {SEARCHES} r join {EPISODES} e on contains(lower(e.title), lower(r.q)) where r.q <> '')"
RANKED = f"(select *, row_number() over (partition by request_id order by id) as rn, count(*) over (partition by request_id) as n from {MATCHES})"
_AUTHOR = f"(select *, 1 + cast(right(author, 1) as bigint) % 3 as page, row_number() over (partition by author order by pos) as rn, count(*) over (partition by author) as n from {FEEDS})"
_REQUEST = "author || '/' || cast(id // 1000 as varchar)"
_AGO = "timestamp '2024-01-24 00:00:00'"

#: Steps by number and what leads from one to another, written out here and not taken from the operators.
STEPS = "END ENTER_PODCAST_NAME PODCAST_CHOICE ENTER_EPISODE_NAME EPISODE_CHOICE ENTER_GLOBAL_SEARCH GLOBAL_EPISODE_CHOICE CUT_INTERVAL".split()
_NEXT = """case
  when x = 'cancel' then 0
  when s = 0 and x = 'cut' then 1 when s = 0 and x = 'search' then 5
  when s = 2 and x = 'id' then 4 when s in (4, 6) and x = 'id' then 7
  when s = 1 and x = 'text_many' then 2 when s = 5 and x = 'text_many' then 6
  when s = 2 and x = 'text_none' then 1 when s = 6 and x = 'text_none' then 5
  when s = 7 and x = 'interval_ok' then 0 else s end"""
FOLD = f"""(with recursive u as materialized (select user_id, symbol as x, row_number() over (partition by user_id order by update_id) as k from {UPDATES}),
  r as (select distinct user_id, cast(0 as bigint) as k, 0 as s, cast(0 as bigint) as reached, cast(0 as bigint) as finished from u
    union all select user_id, k, s, reached | (1 << s), finished + done from (
      select r.user_id, u.k, {_NEXT} as s, reached, finished, cast(s = 7 and x = 'interval_ok' as bigint) as done from r join u on u.user_id = r.user_id and u.k = r.k + 1))
  select user_id, max(k) as n_updates, list_extract({STEPS!r}, arg_max(s, k) + 1) as final_state, arg_max(reached, k) as reached, arg_max(finished, k) as finished from r group by user_id)"""

_TYPED = "kind <> 'callback' and not starts_with(payload, '/') and payload <> 'Help'"
_SYMBOL = """case when kind = 'callback' then case payload when 'next_page' then 'next' when 'prev_page' then 'prev' else 'id' end
  when payload in ('Search Podcast by Name', '/cut_podcast') then 'cut' when payload = 'Search Episodes Globally' then 'search' when payload = '/trending' then 'trending'
  when payload = 'Surprise Me' then 'surprise' when payload = '/cancel' then 'cancel' when payload in ('Help', '/start') then 'help' when starts_with(payload, '/') then 'command_other' else 'text' end"""
_HELD = "(contains(lower(e.title), {0}) or contains(lower(e.description), {0}) or contains(lower(e.author), {0}) or contains(lower(e.feed_title), {0}))"
_TIME = f"""select payload, case when a is null or b is null or a >= b then 'bad' when b - a > 900 then 'too_long' else 'ok' end as timed from (
  select payload, {_seconds("a")} as a, {_seconds("b")} as b from (select payload, {_START.replace("interval_text", "payload")} as a, {_END.replace("interval_text", "payload")} as b from t))"""
#: The raw log replayed one update of each user at a time.
REPLAY = f"""(with recursive l as materialized (select update_id, user_id, kind, payload, {_SYMBOL} as x, {_TYPED} as typed, row_number() over (partition by user_id order by update_id) as k from {RAW_LOG}),
  e as materialized (select * from {EPISODES}), t as materialized (select distinct payload from l where typed), tq as materialized (select payload from t where payload <> ''), sizes as materialized (select feed_id, count(*) as n from e group by feed_id),
  tf as materialized (select payload, count(*) as n_feeds, min(f.id) as one_feed from tq as t join {SHOWS} f on contains(lower(f.title), lower(payload)) or contains(lower(f.author), lower(payload)) group by payload),
  tg as materialized (select payload, count(*) as n_all from tq as t join e on {_HELD.format("lower(payload)")} group by payload),
  tt as materialized ({_TIME}),
  ti as materialized (select payload, cast(e.feed_id as varchar) as feed, count(*) as n, min(e.id) as id, min(enclosure_url) as url, min(e.title) as title from tq as t join e on contains(lower(e.title), lower(payload)) group by all),
  u as materialized (select l.*, coalesce(n_feeds, 0) as n_feeds, cast(one_feed as varchar) as one_feed, coalesce(s1.n, 0) as one_n, coalesce(n_all, 0) as n_all, timed, coalesce(s2.n, 0) as feed_n, cast(e.feed_id as varchar) as e_feed, e.enclosure_url as e_url, e.title as e_title,
      e.description as e_description, e.author as e_author, e.feed_title as e_tags
    from l left join tf on typed and tf.payload = l.payload left join sizes s1 on s1.feed_id = one_feed and n_feeds = 1 left join tg on typed and tg.payload = l.payload left join tt on typed and tt.payload = l.payload
    left join sizes s2 on x = 'id' and s2.feed_id = try_cast(l.payload as bigint) left join e on x = 'id' and e.id = try_cast(l.payload as bigint)),
  lucky as materialized (select cast(id as varchar) as id, enclosure_url, title from e order by md5('7:' || cast(id as varchar)), id limit 1),
  r as (
    select distinct user_id, cast(null as bigint) as update_id, cast(0 as bigint) as k, '' as b, 'END' as was, 'END' as s, cast(null as varchar) as q, cast(null as bigint) as page, cast(null as varchar) as feed, cast(null as varchar) as episode, cast(null as varchar) as url, cast(null as varchar) as title, cast(0 as bigint) as size from l
    union all
    select user_id, update_id, k, b, s,
      case when b in ('cut', 'feed_none', 'feed_page_none') then 'ENTER_PODCAST_NAME' when b in ('search', 'all_none', 'all_page_none') then 'ENTER_GLOBAL_SEARCH' when b in ('trending', 'feed_many') then 'PODCAST_CHOICE'
        when b in ('surprise', 'in_one', 'pick') then 'CUT_INTERVAL' when b in ('cancel', 'no_url', 'ok', 'too_long') then 'END' when b in ('feed_one', 'open') then 'EPISODE_CHOICE'
        when b in ('feed_one_empty', 'open_empty', 'in_page_none') then 'ENTER_EPISODE_NAME' when b = 'all_many' then 'GLOBAL_EPISODE_CHOICE' else s end,
      case when b in ('cut', 'search', 'trending', 'surprise', 'cancel', 'no_url', 'ok', 'too_long') then null when b like 'feed_%' and b <> 'feed_page_none' or b like 'all_%' and b <> 'all_page_none' then payload else q end,
      case when b in ('cut', 'search', 'surprise', 'cancel', 'no_url', 'ok', 'too_long') then null when b = 'trending' or b like 'feed_%' or b in ('all_many', 'all_none', 'open', 'open_empty') then 1 when b in ('page', 'in_page_none', 'all_page_none') then page + d else page end,
      case when b in ('cut', 'search', 'trending', 'surprise', 'cancel', 'no_url', 'ok', 'too_long') then null when b in ('feed_one', 'feed_one_empty') then one_feed when b in ('open', 'open_empty') then payload else feed end,
      case when b in ('cut', 'search', 'trending', 'cancel', 'no_url', 'ok', 'too_long') then null when b = 'surprise' then l_id when b = 'in_one' then cast(i_id as varchar) when b = 'pick' then payload else episode end,
      case when b in ('cut', 'search', 'trending', 'cancel', 'no_url', 'ok', 'too_long') then null when b = 'surprise' then l_url when b = 'in_one' then i_url when b = 'pick' and picked then e_url else url end,
      case when b in ('cut', 'search', 'trending', 'cancel', 'no_url', 'ok', 'too_long') then null when b = 'surprise' then l_title when b = 'in_one' then i_title when b = 'pick' and picked then e_title else title end,
      case when b in ('feed_one', 'feed_one_empty') then one_n when b in ('open', 'open_empty') then feed_n when b in ('all_many', 'all_none') then n_all else size end
    from (
      select r.user_id, u.update_id, u.k, r.s, r.q, r.page, r.feed, r.episode, r.url, r.title, r.size, u.payload, one_feed, one_n, feed_n, n_all, e_url, e_title, ti.id as i_id, ti.url as i_url, ti.title as i_title, lucky.id as l_id, lucky.enclosure_url as l_url, lucky.title as l_title,
        case x when 'next' then 1 else -1 end as d,
        case when s = 'EPISODE_CHOICE' then coalesce(e_feed = r.feed, false) else coalesce(contains(lower(e_title), lower(r.q)) or contains(lower(e_description), lower(r.q)) or contains(lower(e_author), lower(r.q)) or contains(lower(e_tags), lower(r.q)), false) and r.q <> '' end as picked,
        case when x in ('help', 'command_other') then 'same' when s = 'END' then case when x in ('cut', 'search', 'trending', 'surprise') then x else 'same' end when x = 'cancel' then x
          when typed then case
            when s in ('ENTER_PODCAST_NAME', 'PODCAST_CHOICE') then case when n_feeds = 1 and one_n > 0 then 'feed_one' when n_feeds = 1 then 'feed_one_empty' when n_feeds > 1 then 'feed_many' else 'feed_none' end
            when s in ('ENTER_GLOBAL_SEARCH', 'GLOBAL_EPISODE_CHOICE') then case when n_all > 0 then 'all_many' else 'all_none' end
            when s = 'EPISODE_CHOICE' then case coalesce(ti.n, 0) when 0 then 'in_none' when 1 then 'in_one' else 'in_many' end
            when s = 'CUT_INTERVAL' then case when coalesce(r.url, '') = '' then 'no_url' else timed end else 'same' end
          when x = 'id' then case s when 'PODCAST_CHOICE' then case when feed_n > 0 then 'open' else 'open_empty' end when 'EPISODE_CHOICE' then 'pick' when 'GLOBAL_EPISODE_CHOICE' then 'pick' else 'same' end
          when x in ('next', 'prev') then case s when 'PODCAST_CHOICE' then case when r.q is not null and r.page + (case x when 'next' then 1 else -1 end) >= 1 then 'page' else 'feed_page_none' end
            when 'EPISODE_CHOICE' then case when r.page + (case x when 'next' then 1 else -1 end) >= 1 and 5 * (r.page + (case x when 'next' then 1 else -1 end) - 1) < r.size then 'page' else 'in_page_none' end
            when 'GLOBAL_EPISODE_CHOICE' then case when r.page + (case x when 'next' then 1 else -1 end) >= 1 and 5 * (r.page + (case x when 'next' then 1 else -1 end) - 1) < r.size then 'page' else 'all_page_none' end else 'same' end
          else 'same' end as b
      from r join u on u.user_id = r.user_id and u.k = r.k + 1 left join ti on u.typed and ti.payload = u.payload and ti.feed = r.feed cross join lucky))
  select user_id, update_id, was as before, case when b in ('cut', 'search', 'trending', 'surprise') then 'start' when b like '%page_none' then 'page_none' when b like '%one_empty' then 'one_empty' when b in ('open', 'pick') then 'id' when b = 'open_empty' then 'id_empty'
      when b in ('no_url', 'too_long') then b when regexp_matches(b, '^(feed|all|in)_') then regexp_replace(b, '^(feed|all|in)_', '') else b end as outcome, s as after, q, page, feed, episode, url, title from r where k > 0)"""

def _landed(name: str, table: str, columns: str) -> str:
    request = f"{name} || '/' || cast(id // 1000 as varchar)"
    return f"select {request} as request, row_number() over (partition by {name}, id // 1000 order by id) - 1 as pos, id, {columns} from {table} where right({name}, 1) not in ('2', '3', '5')"


SQL = {
    "landed_feeds": _landed("author", FEEDS, "title, author"),
    "landed_items": _landed("feed_title", EPISODES, 'title, enclosure_url as "enclosureUrl"'),
    "landed_episodes": _landed("feed_title", EPISODES, 'title, enclosure_url as "enclosureUrl"'),
    "landed_counts": f"""select rejected, count(*) as n, count(*) as observed from (select distinct author, id // 1000, right(author, 1) in ('2', '3', '5') as rejected from {FEEDS}) group by rejected""",
    "envelope_explode": f"""select {_REQUEST} as request, row_number() over (partition by author, id // 1000 order by id) - 1 as pos, id, title, author, last_update_time
        from {FEEDS} where right(author, 1) not in ('3', '5')""",
    "envelope_status": f"select distinct {_REQUEST} as request, case right(author, 1) when '3' then 'http_404' when '5' then 'empty' else 'ok' end as status from {FEEDS}",
    "label_global": f"select id, substr(coalesce(feed_title, 'Podcast'), 1, 20) || ': ' || substr(coalesce(title, 'Episode'), 1, 30) as label from {EPISODES}",
    "label_feed": f"select id, 'Title: ' || coalesce(title, 'Unknown') || ', Author: ' || coalesce(author, 'Unknown') as label from {FEEDS}",
    "parse_interval": f"select request_id, start_sec, end_sec, {_PARSE} as status from {PARSED}",
    "clip_validate": f"select {_CLIP} from {VALID}",
    "clip_stream": f"select {_CLIP} from {VALID}",
    "clip_filename": f"select request_id, {_NAME} as filename, coalesce(feed_title, 'Podcast') || ' - ' || coalesce(title, 'Episode') || ' (' || interval_text || ')' as clip_title from {VALID}",
    "clip_manifest": f"select request_id, {_NAME} as filename, start_sec, end_sec, status from {VALID}",
    "clip_slice": f"""select request_id, s.episode_id, turn, greatest(seg_start, a) - a as from_sec, least(seg_end, b) - a as to_sec
        from (select request_id, request_id % 100 as episode_id, start_sec % 480 as a, start_sec % 480 + end_sec - start_sec as b from {PARSED} where start_sec < end_sec and end_sec - start_sec <= 900) r
        join {SEGMENTS} s on s.episode_id = r.episode_id and seg_start < b and seg_end > a""",
    "title_contains": f"select r.request_id, e.id from {SEARCHES} r join {EPISODES} e on e.feed_id = r.feed_id and contains(lower(e.title), lower(r.q))",
    "feed_search": f"select id, cast(case when contains(lower(title), 'an') then 0 else 1 end as bigint) as rank from {FEEDS} where contains(lower(title), 'an') or contains(lower(author), 'an')",
    "person_search": f"select id from {EPISODES} where contains(lower(title), 'src1') or contains(lower(description), 'src1') or contains(lower(author), 'src1') or contains(lower(feed_title), 'src1')",
    "person_log": f"select request_id, id from {PERSONS} r join {EPISODES} e on q <> '' and {_HELD.format('lower(q)')}",
    "search_join": f"select request_id, id from {MATCHES}",
    "match_count": f"select r.request_id, count(m.id) as n from {SEARCHES} r left join {MATCHES} m using (request_id) group by r.request_id",
    "match_outcome": f"""select request_id, case when n = 0 then 'none' when n = 1 then 'one' else 'many' end as outcome, case when n = 1 then least_id end as chosen_id
        from (select r.request_id, count(m.id) as n, min(m.id) as least_id from {SEARCHES} r left join {MATCHES} m using (request_id) group by r.request_id)""",
    "select_episode": f"select request_id, episode_id, enclosure_url, title from {CLIPS} r left join {EPISODES} e on e.id = r.episode_id",
    "title_lookup": f"""select request_id, episode_id, coalesce(t.title, 'Podcast') as title from {CLIPS} r
        left join (select id % 500 as id, max_by(title, pos) as title from {FEEDS} group by 1) t on t.id = r.episode_id""",
    "feed_episodes": f"select request_id, feed_id, e.id as episode_id from {SEARCHES} r join {EPISODES} e using (feed_id)",
    "feed_no_episodes": f"select request_id, request_id % 40 as feed_id from {SEARCHES} r where not exists (select 1 from {EPISODES} e where e.feed_id = r.request_id % 40)",
    "episode_page": f"""select request_id, id, rn, n > 5 * page as has_next, page > 1 as has_prev, 'ep ' || coalesce(title, 'Episode') as label
        from {RANKED} where page >= 1 and rn > 5 * (page - 1) and rn <= 5 * page""",
    "feed_page": f"select author, id, rn, n > 5 * page as has_next, page > 1 as has_prev from {_AUTHOR} where rn > 5 * (page - 1) and rn <= 5 * page",
    "feed_page_tail": f"""select author, id, rn, n > 5 * page as has_next, page > 1 as has_prev
        from {_AUTHOR} where rn > greatest(least(n, 5 * page + 1) - 5, 0) and rn <= least(n, 5 * page + 1)""",
    "deep_page": f"""select request_id, event_id, rn, n > 5 * page as has_next, page > 1 as has_prev from {PAGES} r join (
        select event_type, event_id, row_number() over (partition by event_type order by event_id) as rn, count(*) over (partition by event_type) as n from events) e using (event_type)
        where page >= 1 and rn > 5 * (page - 1) and rn <= 5 * page""",
    "page_status": f"""select request_id, page, case when page < 1 then 'bad_page' when 5 * (page - 1) >= coalesce(n, 0) then 'empty' else 'ok' end as status, coalesce(n, 0) as total
        from {PAGES} left join (select event_type, count(*) as n from events group by event_type) using (event_type)""",
    "first5": f"select request_id, id, rn from {RANKED} where rn <= 5",
    "preview3": f"select request_id, n, rn, feed_title, title, enclosure_url from {RANKED} where rn <= 3",
    "random_episode": f"select id, feed_title, title from {EPISODES} order by md5('7:' || cast(id as varchar)), id limit 1",
    "trending_topk": f"""select cast(json_extract_string(props, '$.k') as bigint) as feed_id, count(*) as n from events
        where ts >= {_AGO} and ts < timestamp '2024-01-31 00:00:00' group by 1 order by n desc, feed_id limit 10""",
    "trending_stream": """select strftime(day, '%Y-%m-%d') as day, feed_id, count(*) as n
        from (select cast(json_extract_string(props, '$.k') as bigint) as feed_id, unnest(generate_series(date_trunc('day', ts) - interval 6 day, date_trunc('day', ts), interval 1 day)) as day from events) group by all""",
    "trending_top_stream": """select * from (select day, cast(row_number() over (partition by day order by n desc, feed_id) as bigint) as rank, feed_id, n from (
        select strftime(day, '%Y-%m-%d') as day, feed_id, count(*) as n from (select cast(json_extract_string(props, '$.k') as bigint) as feed_id,
          unnest(generate_series(date_trunc('day', ts) - interval 6 day, date_trunc('day', ts), interval 1 day)) as day from events) group by all)) where rank <= 10""",
    "freshest_feed": f"select id, title, last_update_time from {FEEDS} where last_update_time is not null order by last_update_time desc, pos limit 1",
    "update_symbols": f"""select update_id, case
        when kind = 'callback' then case payload when 'next_page' then 'next' when 'prev_page' then 'prev' else 'id' end
        when payload in ('Trending Podcasts', '/trending now') then 'trending' when payload = '/cut_podcast' then 'cut' when payload = 'Surprise Me' then 'surprise'
        when payload = '/cancel' then 'cancel' when payload = 'Help' then 'help' when payload = 'Search Episodes Globally' then 'search'
        when starts_with(payload, '/') then 'command_other' else 'text' end as symbol from {RAW_UPDATES}""",
    "session_fold": f"select * from {FOLD}",
    "session_stream": f"select * from {FOLD}",
    "session_log": f"select * from {REPLAY}",
    "session_states": f"""select user_id, count(*) as n_updates, arg_max(after, update_id) as final_state, bit_or(cast(1 << (list_position({STEPS!r}, after) - 1) as bigint)) as reached,
        cast(sum(cast(before = 'CUT_INTERVAL' and outcome = 'ok' as bigint)) as bigint) as finished from {REPLAY} group by user_id""",
    "session_context": f"""select user_id, after as state, q, page, feed, episode, url, title from (select *, row_number() over (partition by user_id order by update_id desc) as n from {REPLAY}) where n = 1""",
    "session_rates": f"""select step, updates, users, errors, cancels, finished, 1000 * errors // updates as errors_permille, 1000 * cancels // updates as cancels_permille, 1000 * finished // updates as finished_permille from (
        select before as step, count(*) as updates, count(distinct user_id) as users, count(*) filter (where outcome in ('none', 'page_none', 'one_empty', 'id_empty', 'no_url', 'bad', 'too_long')) as errors,
          count(*) filter (where outcome = 'cancel') as cancels, count(*) filter (where before = 'CUT_INTERVAL' and outcome = 'ok') as finished from {REPLAY} group by before)""",
    "session_funnel": "select step, sum(hit) as users from ("
    + " union all ".join(f"select '{s}' as step, cast((reached & {1 << i}) > 0 as bigint) as hit from {FOLD}" for i, s in enumerate(STEPS))
    + f" union all select 'FINISHED', cast(finished > 0 as bigint) from {FOLD}) group by step",
}
