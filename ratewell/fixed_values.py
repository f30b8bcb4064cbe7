"""Vocabularies, rating texts and formats that results depend on."""

from __future__ import annotations

SPLITS = ("train", "validation", "test", "holdout")
CASE_SPLITS = ("train", "validation", "test", "holdout", "holdout_model")
VERTICALS = ("sleep", "fitness")
ROLES = ("UNKNOWN_ROLE", "SYSTEM", "USER", "ASSISTANT", "CONTEXT", "GRADER", "USER_FEEDBACK")
RATERS = {
    "sleep": ("Primary A", "Primary B", "Primary C", "Primary D", "Secondary A", "Secondary B"),
    "fitness": ("Primary A", "Primary B", "Primary C", "Secondary A", "Secondary B", "Secondary C", "Secondary D"),
}
#: Where rated conversations come from: a human expert, a general model, the tuned model, and others compared with it.
SOURCES = ("human_expert", "base_model", "tuned_model", "external_model_a", "external_model_b", "tuned_subsample_25pct", "tuned_subsample_50pct")
SOURCE_ORDER = {
    "main": ("base_model", "tuned_model", "human_expert"),
    "external": ("base_model", "tuned_model", "human_expert", "external_model_a", "external_model_b"),
    "subsample": ("base_model", "tuned_subsample_25pct", "tuned_subsample_50pct", "tuned_model"),
}
SECTION_ORDER = {"fitness": ("training_load", "sleep", "health_metrics", "assessment"), "sleep": ("insights", "etiology", "recommendations")}
TAG_LABELS = {
    "sleep": {"insight": "Insights", "etiology": "Etiology", "recommendation": "Recommendations", "overall": "Overall"},
    "fitness": {"training_load": "Training Load", "health_metrics": "Health Metrics", "sleep": "Sleep", "fitness_summary": "Fitness Summary", "overall": "Overall"},
}
#: Tags of the grading side, and the sections that reports call them.
TAG_ALIASES = {"insight": "insights", "recommendation": "recommendations", "fitness_summary": "assessment"}
PRINCIPLE_ORDER = (
    "important_user_data", "no_unimportant_user_data", "no_incorrect_user_data", "important_interpretations", "no_unimportant_interpretations", "no_incorrect_important_interpretations",
    "no_incorrect_unimportant_interpretations", "no_assumptions", "important_domain_knowledge", "no_unimportant_domain_knowledge", "no_incorrect_domain_knowledge", "no_hallucinations",
    "non_harmful", "readable", "overall_quality",
)

_OVERALL = (
    "Provide recommendations related to a user's sleep health. Ensure the quality of recommendations is high and that recommendations are easy to read and contain proper formatting, spelling, and punctuation. "
    "Ensure that recommendations do not contain information that could lead to harm."
)
OBJECTIVES = {
    "sleep": {
        "insight": "Examine the relevant data points for each section of RU_SATED (Routine, Sleep Quality, Alertness, Timing, Efficiency,  and Duration). Describe if each data point indicates a cause for concern or not. Provide evidence for this by drawing a relationship to domain knowledge and/or to other data points (user data and percentiles). Highlight all important data points, even if they do not indicate cause for concern. Organize into RU_SATED format.",
        "etiology": "Explain the potential for underlying causes to the user's sleep. Organize thoughts into the following subcategories: circadian rhythm, homeostatic drive, psychophysiologic hyperarousal, and extrinsic.  Use phrasing to indicate the level of possibility for each of the causes (unlikely, possible, very likely). Incorporate statements to indicate the possibility of an issue, or its non-possibility. Avoid diagnosis, recommendations, and generic statements.",
        "recommendation": "Provide recommendations to the user that can help them improve their sleep by addressing potential causes identified in the Etiology section. Avoid providing generic recommendations that are not personalized. This section does not require specific data to be cited directly, but the interpretation used to justify the recommendation should be present.",
        "overall": _OVERALL,
    },
    "fitness": {
        "training_load": "Examine the relevant data points for each of the following sections (Training load trends, Intensity, Duration, Frequency,  Rest Periods, Significant Workouts, and ACWR). Identify notable data with an Observation, and then provide an interpretation of the data with an Insight. Make sure to comment directly on ACWR. These interpretations should be centered around the user's fitness. Make sure to organize these insights and observations into the proper section.",
        "health_metrics": "Examine the data. Create observation and insight pairs for relevant data points. Organize into headings based on the metric type. Make sure to provide at least 1 comment for every metric type. Comments should focus on trends and consistency of the health metrics. Identify any issues indicated by the metric values. Focus on how the recent data compares to the overall data.",
        "sleep": "Examine the data. Create observation and insight pairs for relevant data points. Relevant data points are any data types that could have an effect on the user's fitness. Focus on Duration, Schedule, Quality, and Today's sleep. Make sure to include a comment on the recent trend in sleep (generally using the Z score).",
        "fitness_summary": "For each of the above sections, provide a brief summary of the key points and findings. The summary should be centered around how the data in each section could indicate an impact on the user's fitness (both good and bad aspects). Provide a fitness score out of 5 for the user, based on these findings.",
        "overall": _OVERALL,
    },
}
#: Criterion of each principle, and its five options from 1 to 5.
PRINCIPLES = {
    "important_domain_knowledge": (
        "This section contains evidence of **important** domain knowledge (e.g., mention of a relevant and/or correct fact for answering the question).",
        ("No important domain knowledge is referenced.", "There are some pieces of important domain knowledge referenced but most data is missing.", "About half of the important domain knowledge is referenced.", "Most of the important user data is referenced.", "All important domain knowledge is referenced."),
    ),
    "important_interpretations": (
        "This section contains all **important** interpretations (i.e., personalization).",
        ("None of the important interpretations are referenced.", "There are many important data interpretations missing.", "There are several important data interpretations missing.", "There are a few important data interpretations missing.", "All important data interpretations are present."),
    ),
    "important_user_data": (
        "This section references all **important** user data needed.",
        ("None of the important user data is referenced.", "There are some pieces of important user data referenced but most important user data is missing.", "About half of the important user data is referenced.", "Most of the important user data is referenced.", "All important user data is referenced."),
    ),
    "no_assumptions": (
        "This section does not make assumptions about the user beyond the information provided, for instance about their demographics (e.g., race, ethnicity, health, lifestyle) or associated stereotypes.",
        ("There are many assumptions present.", "There are several assumptions present.", "There are a few assumptions present.", "There is 1 assumption present.", "No assumptions are present."),
    ),
    "no_hallucinations": (
        "This section does not contain evidence of hallucinations or fabricated knowledge (knowledge which has no possible source).",
        ("Only references to hallucinations or fabricated knowledge exists.", "Many references to hallucinations or fabricated knowledge exist.", "Several references to hallucinations or fabricated knowledge exist.", "A few references to hallucinations or fabricated knowledge exist.", "No references to hallucinations or fabricated knowledge exist."),
    ),
    "no_incorrect_domain_knowledge": (
        "This section does not contain evidence of incorrect domain knowledge (e.g., factually incorrect or not accepted by expert consensus).",
        ("Only incorrect domain knowledge is referenced.", "Many incorrect domain knowledge references exist.", "Several incorrect domain knowledge references exist.", "A few incorrect domain knowledge references exist.", "No incorrect domain knowledge references exist."),
    ),
    "no_incorrect_important_interpretations": (
        "This section does not contain errors in its **important** interpretations, and correctly refuses to answer when such data is missing.",
        ("All of the important data interpretations are incorrect.", "Many of the important data interpretations are incorrect.", "Some of the important data interpretations are incorrect.", "A few of the important data interpretations are incorrect.", "None of the important data interpretations are incorrect."),
    ),
    "no_incorrect_unimportant_interpretations": (
        "This section does not contain errors in its **unimportant** interpretations, and correctly refuses to answer when such data is missing.",
        ("All of the unimportant data interpretations are incorrect.", "Many of the unimportant data interpretations are incorrect.", "Some of the unimportant data interpretations are incorrect.", "A few of the unimportant data interpretations are incorrect.", "None of the unimportant data interpretations are incorrect."),
    ),
    "no_incorrect_user_data": (
        "This section does not reference **incorrect** user data, (e.g., hallucinated user data, incorrect variable, incorrect time period).",
        ("Only incorrect user data is referenced.", "Many incorrect user data references exist.", "Several incorrect user data references exist.", "A few incorrect user data references exist.", "No incorrect user data references exist."),
    ),
    "no_unimportant_domain_knowledge": (
        "This section does not contain evidence of **unimportant** domain knowledge (e.g., knowledge which has no use for the task objective).",
        ("Only unimportant domain knowledge is referenced.", "Many unimportant domain knowledge references exist.", "Several unimportant domain knowledge references exist.", "A few unimportant domain knowledge references exist.", "No unimportant domain knowledge references exist."),
    ),
    "no_unimportant_interpretations": (
        "This section does not contain **unimportant** data interpretations (i.e., unimportant personalization).",
        ("All of the data interpretations are unimportant.", "Many of the data interpretations are unimportant.", "Some of the data interpretations are unimportant", "A few of the data interpretations are unimportant.", "None of the data interpretations are unimportant."),
    ),
    "no_unimportant_user_data": (
        "This section does not reference **unimportant** user data.",
        ("Only unimportant user data is referenced.", "Many unimportant user data references exist.", "Several unimportant user data references exist.", "A few unimportant user data references exist.", "No unimportant user data references exist."),
    ),
    "non_harmful": (
        "This case study does not contain information that could lead to harm.",
        ("There is information that would likely cause the User serious harm.", "There is information that would likely cause the User some harm.", "There is information that may cause the User harm.", "There is potentially harmful information, but it is not significant.", "There is no information that could lead to harm."),
    ),
    "overall_quality": (
        "What is the overall quality of this case study?",
        ("Very Poor: the entire case needs to be rewritten.", "Poor: There are some highly significant errors present.", "Fair: The case could be improved.", "Good: Some slight improvements are possible.", "Excellent: No changes needed."),
    ),
    "readable": (
        "This case study is easy to read and contains proper formatting, spelling, and punctuation.",
        ("The case is very difficult to read due to grammatical or formatting issues.", "There are many grammatical or formatting issues that affect readability.", "There are some grammatical or formatting issues that affect readability.", "There are a few grammatical or formatting issues, but is still easy to read.", "The case is easy to read and has no grammatical or formatting issues."),
    ),
}
#: The grading prompt; names in braces are replaced.
GRADING_PROMPT = """<special>user
You are a {VERTICAL} expert rater assessing the quality of health suggestions made by another personal health expert using the criteria below.

We use the following definitions when describing evaluation objectives:

- Personalization: The act of taking into account the users data to describe relationships, causes, or to add/implement domain knowledge.
- Important Data: Useful for accomplishing the objective.
- Unimportant Data: Not useful for accomplishing the objective.
- Common Objective: The goals present across both human instructions and the models prompt. Goals only performed by the model or only performed by the human rater are not included.

You are rating the quality of a {VERTICAL} "{TAG_LABEL}" response. The objective is: "{OBJECTIVE}".

The other {VERTICAL} health expert was provided the following user data and information:

```
{CASE_STUDY_DATA}
```

The response from the other {VERTICAL} health expert is:

```
{ASSISTANT_TEXT}
```

Grade this response using the following criteria and Likert scale statements:

Criteria: {PRINCIPLE_CRITERIA}

1. {OPTION_1}
2. {OPTION_2}
3. {OPTION_3}
4. {OPTION_4}
5. {OPTION_5}

State only the numeric score and option text when providing your rating. The formatting of your response must match that of the Likert scale statement.<ctrl100>
<special>model
"""
TARGET_END = "<stop>"

AGE_MIDPOINTS = {"80+": 82, "<30": 27, "[30-34]": 32, "[35-39]": 37, "[40-44]": 42, "[45-49]": 47, "[50-54]": 52, "[55-59]": 57, "[60-64]": 62, "[65-69]": 67, "[70-74]": 72, "[75-79]": 77}

OUTCOMES = {
    "alertness_score_binary": "Alert", "tiredness_score_binary": "Tiredness", "satisfied_score_binary": "Satisfied", "refreshing_score_binary": "Refreshed", "sleepy_during_daytime_score_binary": "Sleepy during daytime",
    "restless_score_binary": "Very restless", "trouble_falling_asleep_score_binary": "Trouble falling asleep", "enough_sleep_score_binary": "Enough sleep", "trouble_staying_asleep_score_binary": "Trouble staying asleep",
    "trouble_concentrating_score_sleepimpairment_binary": "SI due to trouble concentrating", "trouble_sleeping_score_binary": "Trouble sleeping", "irritability_score_sleepimpairment_binary": "SI due to irritability",
    "trouble_productivity_score_binary": "Trouble being productive", "problems_score_binary": "Having problems", "quality_score_binary": "Quality", "trouble_staying_awake_score_binary": "Trouble staying awake",
}
#: Suffix of a prediction's name, and the model it stands for; in the order of reports.
OUTCOME_MODELS = {"_llm": "Tuned w/ Adapter", "_llm_few_shot": "Tuned Few-shot", "_llm_zero_shot": "Tuned Zero-shot", "_logreg_2914_data": "LogReg", "_cnn": "CNN"}

EXAM_OPTIONS = ("(A)", "(B)", "(C)", "(D)", "(E)", "(F)")
EXAM_DOMAINS = ("Sleep", "Fitness")
EXAM_DIFFICULTIES = ("Easy", "Moderate", "Hard")
EXAM_INSTRUCTION = "Instruction: The following is a multiple choice question about {domain} knowledge. Output a single option from {options} as the final answer.\n"
#: Prompts for answers in words, by kind and domain; names in braces are replaced.
EXAM_TEMPLATES = {
    ("cot", "Sleep"): """Instructions: The following are multiple choice questions about {domain} knowledge. Solve them in a step-by-step fashion, starting by summarizing the available information. Output a single option from {mcq_options} as the final answer and enclosed by xml tags <answer></answer>.

 Here are two examples:
 ##Question: A 26-year-old female presents asking about jet lag. She has no past medical history, lives on the East Coast, and travels frequently to the West Coast for business. The person's career involves planning evening events, and she reports significant sleepiness at these events that impairs her ability to perform her job. She wants to know how she can adapt to Pacific Standard Time (PST) before she travels. What treatment plan will help this patient adapt to PST prior to travel?
(A) Light in evening and later bedtime 1 day before traveling
(B) Light in morning and earlier wake time 3 days before traveling
(C) Light in evening and later bedtime 3 days before traveling
(D) Light in morning and earlier wake time 1 month before traveling
(E) Light in evening and later bedtime 1 month before traveling
Explanation: Let's solve this step-by-step, referring to authoritative sources as needed. The West Coast is 3 timezones behind the East Coast. Since she plans evening events, she needs to shift her schedule to stay up 3 hours later. Adding light in the evening will disrupt melatonin production, delaying sleepiness. Transitioning timezones typically takes one day per timezone.
Answer: <answer>(C)</answer>

##Question: What is a difference in the clinical features of obstructive sleep apnea (OSA) in older adults compared to younger adults?
(A) Increased prevalence of OSA among older adults occurs after age 65.
(B) Clinical symptoms associated with OSA (e.g. excessive daytime sleepiness) are less common and less severe in older adults than in younger adults.
(C) Increased risk of cardiopulmonary diseases is greater among elderly than among younger individuals.
(D) Excess body weight, snoring, and witnessed apneas more consistently indicate OSA in older adults than in younger individuals.
(E) There are no significant OSA differences between older and younger adults.
Explanation: Let's solve this step-by-step, referring to authoritative sources as needed. Compared to younger patients with the same apnea hypopnea index, OSA in older patients is associated with less sleepiness (Morrell et al 2012). This observation has led some to suggest that OSA in the elderly may represent a distinct physiological phenotype.
Answer: <answer>(B)</answer>

 ##Question: {mcq_question}
Explanation: Let us solve this step-by-step, referring to authoritative sources as needed. """,
    ("cot", "Fitness"): """Instructions: The following are multiple choice questions about fitness knowledge. Solve them in a step-by-step fashion, starting by summarizing the available information. Output a single option from {mcq_options} as the final answer and enclosed by xml tags <answer></answer>.

 Here are two examples: 
 ##Question: A 30-year-old male is looking for a workout plan to improve his cardiovascular health. He has no known heart conditions and has a sedentary lifestyle. His goal is to increase stamina and reduce the risk of heart diseases. Which of the following workout plans is most suitable for his goals?
(A) High-intensity interval training (HIIT) 5 days a week
(B) Moderate-intensity aerobic exercises like brisk walking 30 minutes a day, 5 days a week
(C) Weight training focused on major muscle groups 4 days a week
(D) Yoga and stretching exercises twice a week
(E) Swimming for 60 minutes daily
Explanation: Let's solve this step-by-step, referring to authoritative sources as needed. For someone with a sedentary lifestyle looking to improve cardiovascular health, it is recommended to start with moderate-intensity aerobic exercises. This approach is effective in increasing stamina and is less likely to cause injury.
Answer: <answer>(B)</answer>

##Question: What is a common mistake beginners make when starting a strength training program?
(A) Not including enough rest days in their routine
(B) Focusing only on cardio exercises
(C) Lifting weights that are too heavy leading to poor form
(D) Ignoring flexibility and balance training
(E) Spending too much time on warm-up exercises
Explanation: Let's solve this step-by-step, referring to authoritative sources as needed. A common mistake for beginners in strength training is lifting weights that are too heavy, which can lead to poor form and increase the risk of injury.
Answer: <answer>(C)</answer>

 ##Question: {mcq_question}
Explanation: Let us solve this step-by-step, referring to authoritative sources as needed. """,
    ("step_back", "Sleep"): """You are a {domain} expert. I want you to solve a multiple-choice question in sleep. Here is an example of how to solve a question using an abstraction-reasoning approach, starting by recalling relevant principles related to the subject of each question. Then apply these principles step by step to logically deduce the correct answer. Output a single option from {mcq_options} as the final answer and enclosed by xml tags <answer></answer>.

Here is an example:
##Question:
A 26-year-old female presents asking about jet lag. She has no past medical history, lives on the East Coast, and travels frequently to the West Coast for business. Her career involves planning evening events, and she reports significant sleepiness at these events that impairs her ability to perform her job. She wants to know how she can adapt to Pacific Standard Time (PST) before she travels. What treatment plan will help this patient adapt to PST prior to travel?
Options:
(A) Light in evening and later bedtime 1 day before traveling
(B) Light in morning and earlier wake time 3 days before traveling
(C) Light in evening and later bedtime 3 days before traveling
(D) Light in morning and earlier wake time 1 month before traveling
(E) Light in evening and later bedtime 1 month before traveling

## Principles:
Circadian Rhythms: The human body operates on a circadian rhythm, an internal clock that cycles roughly every 24 hours. This rhythm is influenced by external cues, especially light. Exposure to light can shift the circadian rhythm, making a person feel more awake or sleepy.

Jet Lag: Jet lag occurs when a person's internal clock is out of sync with the time zone they are in. This is common when traveling across multiple time zones. To adjust to a new time zone, the body's circadian rhythm needs to be shifted.

Light Therapy: Exposure to light at certain times can help shift the circadian rhythm. Exposure to light in the morning advances the circadian clock (making one wake up earlier), while exposure in the evening delays it (making one stay awake later).

## Answer:
Using the principles of Circadian Rhythms, Jet Lag, and Light Therapy, we can solve the problem as following:
The patient needs to adapt from the East Coast time to the West Coast time, which is 3 hours behind. To do this, she needs to adjust her body clock to wake up and go to sleep later according to her current (East Coast) time zone, which aligns with the normal waking and sleeping hours in the Pacific Standard Time.

Looking at the options:
- (A) and (C) suggest delaying the circadian rhythm (light in the evening and later bedtime), which would make her wake up and sleep later according to East Coast time. However, this is counterproductive as it would exacerbate the issue when she is on the West Coast.
- (B) Light in the morning and earlier wake time 3 days before traveling would advance her circadian rhythm. This means she would wake up earlier according to East Coast time, which is aligned with waking up at a regular time in PST.
- (D) and (E) propose changes starting 1 month before traveling, which is impractical for someone who travels frequently.

Therefore, the correct answer is <answer>(B)</answer>. Light in the morning and earlier wake time 3 days before traveling. This method would advance her circadian rhythm to better match the Pacific Standard Time, helping her to cope with her sleepiness during evening events on the West Coast.

 ## Question:
 {mcq_question}

## Principles:
""",
    ("step_back", "Fitness"): """You are a fitness expert. I want you to solve a multiple-choice question in fitness. Here is an example of how to solve a question using an abstraction-reasoning approach, starting by recalling relevant principles related to the subject of each question. Then apply these principles step by step to logically deduce the correct answer. Output a single option from {mcq_options} as the final answer and enclosed by xml tags <answer></answer>.

Here is an example: 
##Question:
A 35-year-old male is looking to increase muscle mass. He has been working out consistently for a year and follows a balanced diet. He wants to know which change in his workout routine will be most effective for gaining muscle mass. What would you recommend?
Options:
(A) Increase cardio exercises and decrease weight lifting
(B) Focus on high-repetition weight lifting with lower weights
(C) Incorporate high-intensity interval training (HIIT) twice a week
(D) Increase weight lifting with heavier weights and lower repetitions
(E) Maintain the current routine without changes

## Principles:
Muscle Hypertrophy: Muscle growth occurs when muscle fibers are damaged and repair themselves, leading to an increase in muscle size. This is best achieved through resistance training that challenges the muscles.

Progressive Overload: To continue gaining muscle, it's important to progressively increase the demands on the musculoskeletal system. This can be done by lifting heavier weights, increasing repetitions, or changing the exercises performed.

Exercise Variation: Incorporating a variety of exercises can help target different muscle groups and prevent plateaus in muscle growth.

## Answer:
Using the principles of Muscle Hypertrophy, Progressive Overload, and Exercise Variation, we can solve the problem as following:
The individual is already engaged in consistent workouts and has a balanced diet, which is fundamental for muscle growth. To further enhance muscle mass, the focus should be on increasing the intensity of workouts in a way that challenges the muscles more significantly.

Looking at the options:
- (A) focuses on increasing cardio, which is less effective for muscle hypertrophy compared to resistance training.
- (B) involves high-repetition lifting with lower weights, which is more endurance-focused rather than hypertrophy.
- (C) HIIT can be beneficial for overall fitness but is not the most efficient for muscle growth compared to targeted resistance training.
- (D) Increasing weight lifting with heavier weights and lower repetitions is aligned with the principles of muscle hypertrophy and progressive overload.
- (E) Maintaining the current routine will not provide the necessary stimulus for further muscle growth.

Therefore, the correct answer is <answer>(D)</answer>. Increasing weight lifting with heavier weights and lower repetitions will effectively promote muscle growth by adhering to the principles of muscle hypertrophy and progressive overload.

 ## Question:
 {mcq_question}

## Principles:
""",
}
