"""Schemas of the inputs; ids are strings everywhere."""

RATINGS = "case_study_id string, conversation_id string, conversation_source string, rater string, tag string, principle string, rating int"
EXPERT_RATINGS = "case_study_id string, rater string, tag string, principle string, conversation_source string, rating int"
_CHUNK = "struct<text: string, feedback: struct<type: string, category: string, text: string>, image_base64: string>"
CONVERSATION = f"case_study_id string, conversation_id string, messages array<struct<tag: string, role: string, chunks: array<{_CHUNK}>, score: float>>"
_TENSOR = "struct<bytes_list: array<binary>, float_list: array<float>, int64_list: array<bigint>>"
CASE_STUDY = f"case_study_id string, contextual_features array<struct<tag: string, tensors: map<string, {_TENSOR}>>>, user_inputs array<struct<tag: string, prompt: string, response: string>>"
EXAMPLE = "vertical string, case_study_id string, conversation_id string, inputs string, targets string, rater string, conversation_source string, tag string, principle string, rating bigint"
SLEEP_CASE = "case_study_id string, user_id string, vertical string, split string, input string, insight_output string, etiology_output string, recommendation_output string"
FITNESS_INPUTS = ("demographics_input", "training_load_input", "sleep_input", "health_metrics_input", "muscle_soreness_input", "subjective_readiness_input")
FITNESS_OUTPUTS = ("demographics_output", "training_load_output", "sleep_output", "health_metrics_output", "readiness_assessment_output")
FITNESS_CASE = "case_study_id string, user_id string, vertical string, split string, " + ", ".join(f"{c} string" for c in FITNESS_INPUTS + FITNESS_OUTPUTS)
EXAM = "question string, choices string, domain string, difficulty string, answer string"
OUTCOMES = "prediction_name string, metric_name string, mean double, ci_lower double, ci_upper double"
PREVALENCE = "mean double, ci_lower double, ci_upper double, Target string, Model string"
