"""Record shapes that stages exchange, as Spark DDL."""

WORD = "struct<word:string,start:double,end:double,start_offset:int,end_offset:int>"
SPAN = "struct<start:int,end:int,text:string>"
TARGET = (
    "struct<tgt_lan:string,system:string,text:string,reference:string,span:string,span_start:int,span_end:int,"
    "intended:string,harm_types:array<string>,harmfulness:int,explanation:string,error_source:string>"
)
MANIFEST = (
    "audio_filepath string, sampling_rate int, split string, language string, key string, video_id string, start_seconds double, end_seconds double, "
    "human_transcript string, asr_transcript string, audio_id string, session string, speaker_id string, raw_text string, normalized_text string"
)
ASR_SEGMENT = f"segment string, start double, end double, start_offset int, end_offset int, words array<{WORD}>"
STREAM_STEP = "emission_time double, start double, end double, text string, unconfirmed_text string, is_final boolean"
ALIGNED_SENTENCE = (
    "document string, dataset string, src_language string, systems_info map<string,struct<lan:string,is_human:boolean>>, segmented_by string, audio string, beg double, end double, "
    f"text map<string,string>, alignment map<string,string>, words map<string,array<{WORD}>>"
)
FLAGGED_SEGMENT = (
    "document string, dataset string, src_language string, audio string, beg double, end double, segmented_by string, asr string, asr_system string, gold_transcript string, "
    f"targets array<{TARGET}>, annotator struct<model:string,backend:string,level:string,annotated:array<string>,shown:array<string>>"
)
GOLD_SEGMENT = FLAGGED_SEGMENT + f", gold_annotations array<boolean>, gold_annotation_details array<string>, gold_spans array<array<{SPAN}>>"
ANNOTATION_PAGE = (
    "user_id string, item array<struct<item_id:string,src:string,instructions:string,tgt:map<string,string>>>, "
    "annotation array<map<string,struct<error_spans:array<struct<start_i:int,end_i:int>>>>>"
)
