"""Explicit schemas of the nested inputs."""

SEGMENT = "struct<start_sec:double,end_sec:double,text:string>"
TIME = "struct<start_sec:double,end_sec:double>"
FRAME = f"struct<id:string,time:double,detect_time:double,mode:string,image:string,ocr:string,time_range:{TIME}>"
SLIDE = f"struct<slide_id:string,time:{TIME},frames:array<{FRAME}>,full_text:string,proper_nouns:array<string>,asr:array<{SEGMENT}>,asr_no_prompt:array<{SEGMENT}>>"
META = "struct<model:string,video:string,started_at:string,finished_at:string,elapsed_sec:double,proper_nouns_global:array<string>>"
LECTURE = f"meta {META}, slides array<{SLIDE}>"
DETAIL = "struct<chunk_mode:string,slides_per_chunk:int,slide_overlap:int,minutes_per_chunk:double,time_overlap_sec:double,questions_per_chunk:int,bloom_level:string,rag_k:int,chroma:string>"
QUESTION = (
    f"question_id string, model string, method string, detail_setting {DETAIL}, chunk_id string, slide_ids array<string>, start_sec double, end_sec double, "
    "seeds array<string>, cot string, question string, choice_A string, choice_B string, choice_C string, choice_D string, answer string, reason string, bloom_level string"
)
#: The same as fields of a struct.
QUESTION_FIELDS = ", ".join(f.replace(" ", ":", 1) for f in QUESTION.split(", "))
AXIS = "axis_ord int, axis string, description string"
SCORE = "video_id string, question_id string, model string, method string, chunk_mode string, axis string, trial int, score int, cot string, reason string, settings_hash string"
