"""Explicit schemas of evaluation records. Logs hold several kinds of record, so theirs is the superset, all nullable."""

from __future__ import annotations

CROP = "struct<requested_window:array<double>,decoded_duration_seconds:double,excerpt_sha256:string,audio_storage:string,video_storage:string>"
CALL = (
    "struct<model_output:string,generated_tokens:int,reached_token_limit:boolean,stage:string,window:array<double>,"
    f"crop:{CROP},seconds:double,peak_gpu_gib:double,serialized_prompt:string,input_tokens:int,audio_tokens:int,"
    "video_tokens:int,audio_sha256:string,audio_seconds_supplied:double,frames:int,source_frames:int,source_fps:double,"
    "duration_seconds:double,frame_indices:array<bigint>,timestamps_seconds:array<double>,effective_fps:double,"
    "raw_frames_sha256:string,processed_frame_shape:array<int>,audio_window_start:int,processor_fps:double,"
    "audio_seconds_encoded:double,audio_native_padded_seconds:int,audio_snippet_starts_seconds:array<double>,"
    "audio_native_policy:string,video_tensor_sha256:string,pixel_shape:array<int>,video_metadata:string,"
    "native_audio_clip_timepoints:array<array<double>>,native_audio_decode_ok:boolean,audio_feature_shape:array<int>,"
    "elapsed_seconds:double>"
)
DECISION = "struct<center:double,fallback:boolean,reason:string,window:array<double>>"
ARM = f"struct<model_output:string,decisions:array<{DECISION}>,calls:array<{CALL}>,logical_calls:int,global_call_shared_between_arms:boolean>"


QUESTIONS = "qid string, task string, question_prompt string, clip_path string, prefix2text map<string,string>, video_name string"
PREDICTIONS = (
    "qid string, task string, dataset string, model string, phase string, gpu string, status string, started_at double,"
    "finished_at double, seconds double, duration_seconds double, actual_new_calls int,"
    f"arms map<string,{ARM}>, direct_baseline_check {CALL}, repeat_matches map<string,boolean>,"
    "error_type string, error string, traceback string"
)
HISTORY = (
    "qid string, status string, model_output string, frames int, audio_sha256 string, video_tensor_sha256 string,"
    "raw_frames_sha256 string, input_tokens int, audio_tokens int, video_tokens int, elapsed_seconds double, seconds double"
)
TRUTH = "qid string, task string, options array<string>, correct_answer string, answer_label string"
STATE = "model string, gpu string, dataset string, phase string, attempt int, status string, error string, time double"
PROGRESS = "completed bigint, total bigint, last_qid string, last_status string, updated_at double, last_seconds double"
RESULT_ROWS = "question_id string, video_id string, question string, choices string, answer string, category string, sub_category string, task_id string, response string"
