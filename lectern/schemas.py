"""Schemas of the tables, as DDL; JSON and CSV are never read by inference."""

SEGMENTS_JSON = (
    "segments array<struct<segment_id:bigint,start_sec:double,end_sec:double,text:string,"
    "translated_text:string,target_language:string>>, target_language string"
)
SLIDE_CHANGES_CSV = (
    "event_id bigint, transition_no bigint, frame_id_0 bigint, frame_id_1 bigint, event_frame bigint, "
    "time_sec double, timecode string"
)
FRAME_RUNS_CSV = "slide_id bigint, f0 bigint, f1 bigint"
TRANSITIONS_CSV = "transition_no bigint, frame_id_0 bigint, frame_id_1 bigint"
SLIDE_MAP_JSON = (
    "events array<struct<event_id:string,bucket_id:string,slide_start:double,slide_end:double,is_no_slide:string,"
    "merge_target_event_id:string,text:string,translated_text:string,target_language:string,"
    "segments_count:bigint,source_segment_ids:string>>"
)
TERMBASE_CSV = "source_text string, target_language string, target_text string, case_sensitive string"
LANGUAGES_JSON = "label string, tts_language_code string, translate_language_code string, launch_readiness string"
ALIGNMENT_JSON = (
    "segments array<struct<segment_id:bigint,source_start_sec:double,source_end_sec:double,tts_start_sec:double,"
    "tts_end_sec:double>>, words array<struct<text:string,normalized:string,start_sec:double,end_sec:double>>"
)
GLOSSARY_JSON = "entries array<struct<source_text_norm:string,target_text:string>>"
LLM_ITEMS = "array<struct<index:bigint,translated_text:string>>"
