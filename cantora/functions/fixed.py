"""Word lists, weights and style tables that results depend on."""

# fixed values: cue words of each channel
CUES = {
    "loss": ["ស្លាប់", "ស្លាប់បាត់", "បាត់បង់", "បាត់", "យំ", "ទឹកភ្នែក", "ឈឺចាប់", "ការបាត់បង់", "ខ្មោច", "ពិធីបុណ្យសព", "ទុក្ខ", "ស្រវឹងចិត្ត", "អស់សង្ឃឹម", "died", "death", "dead", "gone", "lost", "loss", "tears", "crying", "funeral", "grief", "empty", "never came back", "buried"],
    "love": ["ស្នេហា", "ស្រលាញ់", "ស្រឡាញ់", "ចិត្ត", "ថើប", "ដៃ", "ឱប", "អារម្មណ៍", "នឹក", "រំលឹក", "ចងចាំ", "អភ័យទោស", "ស្មោះ", "ភក្តី", "ក្តីសង្ឃឹម", "love", "loved", "heart", "kiss", "kissed", "held", "hug", "missing you", "miss you", "remember", "still", "again", "home", "forever", "promise"],
    "danger": ["គ្រោះថ្នាក់", "ភ័យ", "ខ្លាច", "សម្ងាត់", "លាក់", "ឃាតកម្ម", "កាំបិត", "កាំភ្លើង", "ឈាម", "ងងឹត", "ស្ងាត់", "រត់", "ស្រែក", "គេច", "តាម", "មនុស្សចម្លែក", "ទ្វារ", "ស្លាប់", "អន្ទាក់", "danger", "dangerous", "fear", "afraid", "secret", "hidden", "blood", "knife", "gun", "dark", "silent", "quiet", "suddenly", "scream", "ran", "escape", "watched", "followed", "door", "trap", "something was wrong"],
    "revelation": ["ភ្ញាក់ផ្អើល", "រកឃើញ", "តាមពិត", "ពិតប្រាកដ", "ទើបដឹង", "ចម្លើយ", "ការពិត", "ភ្លាមៗ", "ស្រាប់តែ", "បង្ហាញ", "ដឹង", "សម្រេច", "revealed", "discovered", "truth", "realized", "realised", "finally", "suddenly", "found out", "in fact", "actually", "the answer"],
    "joy": ["សប្បាយ", "រីករាយ", "សង្ឃឹម", "ជោគជ័យ", "ញញឹម", "សើច", "ពន្លឺ", "អបអរ", "ស្រស់ស្អាត", "អច្ឆរិយៈ", "joy", "happy", "hope", "victory", "smile", "laughed", "light", "beautiful", "wonderful", "celebrate"],
    "memory": ["អតីតកាល", "កាលពី", "ពេលនោះ", "ថ្ងៃនោះ", "រំលឹក", "នឹកឃើញ", "ចាស់", "កុមារភាព", "ធ្លាប់", "memory", "memories", "once", "used to", "back then", "that day", "childhood", "long ago", "remember when"],
    "scale": ["រាជាណាចក្រ", "ចក្រភព", "សតវត្ស", "ប្រវត្តិសាស្ត្រ", "សង្គ្រាម", "បដិវត្តន៍", "អរិយធម៌", "រាជវង្ស", "បុរាណ", "empire", "kingdom", "century", "history", "war", "revolution", "civilization", "ancient", "dynasty", "nations"],
}

# fixed values: the emotion of each channel
EMOTION = {"loss": "grief", "love": "tenderness", "danger": "tension", "revelation": "revelation", "joy": "hope", "memory": "reflection", "scale": "gravity", "none": "neutral"}

# fixed values: weight of loss, love, danger, revelation, joy, memory, scale in each style
WEIGHTS = {
    "natural": (6, 5, 8, 6, 6, 4, 3),
    "storytelling": (12, 11, 14, 13, 12, 9, 4),
    "novel": (10, 10, 11, 11, 9, 9, 5),
    "documentary": (6, 4, 7, 9, 4, 4, 12),
    "trailer": (12, 8, 18, 16, 10, 6, 16),
    "audiobook": (11, 10, 12, 12, 9, 8, 5),
    "news": (6, 2, 9, 8, 4, 2, 10),
    "explainer": (4, 4, 6, 10, 8, 4, 8),
    "thriller": (10, 6, 20, 17, 4, 6, 4),
    "meditation": (3, 4, 2, 3, 3, 3, 1),
    "inner_monologue": (13, 13, 11, 13, 8, 12, 3),
    "sad_romantic": (15, 15, 6, 11, 5, 13, 3),
    "cinematic": (14, 13, 15, 15, 11, 11, 9),
}

# fixed values: of each style its intensity band and base; pace band; volume band; pauses after period, question, exclamation,
# ellipsis and paragraph; ending rate and pause; dialogue rate and volume; contrast; locked pace and gain
STYLE_FIELDS = "style lo hi base pace0 pace1 vol0 vol1 p_period p_question p_exclaim p_ellipsis p_para end_rate end_pause dlg_rate dlg_vol contrast lock_pace lock_gain".split()
STYLES = [
    ("natural", 10, 40, 22, 0.97, 1.04, -1.0, 1.0, 1.0, 1.05, 1.25, 1.4, 1.7, 0.98, 1.15, 1.02, 0.5, 0.55, 1.00, 0.0),
    ("storytelling", 20, 75, 38, 0.9, 1.1, -1.5, 2.5, 1.15, 1.15, 1.45, 1.7, 2.2, 0.93, 1.35, 1.04, 1.0, 0.8, 0.96, 0.3),
    ("novel", 15, 60, 30, 0.94, 1.05, -1.0, 1.8, 1.15, 1.1, 1.3, 1.6, 2.0, 0.95, 1.3, 1.03, 0.8, 0.7, 0.95, -0.4),
    ("documentary", 12, 48, 26, 0.94, 1.02, -0.8, 1.2, 1.2, 1.05, 1.2, 1.5, 2.3, 0.96, 1.4, 1.0, 0.3, 0.6, 0.94, -0.5),
    ("trailer", 35, 100, 58, 0.78, 1.18, -1.5, 4.0, 1.5, 1.4, 1.7, 2.1, 2.8, 0.85, 1.8, 0.98, 0.8, 0.95, 0.90, 0.7),
    ("audiobook", 15, 55, 28, 0.95, 1.06, -0.6, 1.6, 1.15, 1.1, 1.3, 1.55, 2.1, 0.96, 1.35, 1.05, 0.7, 0.65, 0.99, -0.2),
    ("news", 10, 38, 20, 1.04, 1.1, -0.4, 1.4, 1.05, 1.15, 1.3, 1.3, 1.3, 1.0, 1.05, 1.0, 0.0, 0.35, 1.07, 0.4),
    ("explainer", 18, 52, 28, 0.98, 1.07, -0.6, 1.6, 1.1, 1.2, 1.3, 1.4, 1.8, 0.97, 1.2, 1.02, 0.4, 0.55, 1.02, 0.1),
    ("thriller", 25, 88, 42, 0.84, 1.16, -2.0, 2.2, 1.5, 1.6, 1.5, 2.0, 2.5, 0.88, 1.7, 0.97, 0.4, 0.9, 0.93, -0.9),
    ("meditation", 5, 25, 10, 0.78, 0.86, -2.0, 0.5, 1.9, 1.7, 1.7, 2.4, 3.2, 0.9, 1.8, 0.92, 0.0, 0.25, 0.84, -1.2),
    ("inner_monologue", 12, 62, 26, 0.82, 0.98, -2.2, 1.2, 1.4, 1.5, 1.4, 1.9, 2.2, 0.9, 1.5, 0.98, 0.3, 0.7, 0.91, -0.7),
    ("sad_romantic", 20, 70, 34, 0.86, 1.0, -2.4, 1.0, 1.45, 1.6, 1.35, 2.0, 2.4, 0.88, 1.6, 0.96, 0.2, 0.85, 0.90, -0.7),
    ("cinematic", 25, 95, 44, 0.86, 1.14, -2.6, 3.2, 1.4, 1.35, 1.6, 2.0, 2.6, 0.88, 1.7, 1.03, 1.0, 1.0, 0.99, 0.0),
]

# fixed values: other names of styles
STYLE_ALIASES = {
    "natural read": "natural", "natural_read": "natural", "narrative storytelling": "storytelling", "narrative": "storytelling", "narrative_storytelling": "storytelling", "novel narration": "novel", "novel_narration": "novel", "movie trailer": "trailer", "movie_trailer": "trailer", "audio book": "audiobook", "news anchor": "news", "news_anchor": "news", "inner monologue": "inner_monologue", "internal monologue": "inner_monologue", "monologue": "inner_monologue", "sad romantic": "sad_romantic", "melancholic love": "sad_romantic", "sad romantic / melancholic love": "sad_romantic", "emotional cinematic storytelling": "cinematic", "emotional_cinematic_storytelling": "cinematic",
}

# fixed values: spoken digits, tens, scales
ONES = ["សូន្យ", "មួយ", "ពីរ", "បី", "បួន", "ប្រាំ", "ប្រាំមួយ", "ប្រាំពីរ", "ប្រាំបី", "ប្រាំបួន"]
TENS = ["", "ដប់", "ម្ភៃ", "សាមសិប", "សែសិប", "ហាសិប", "ហុកសិប", "ចិតសិប", "ប៉ែតសិប", "កៅសិប"]
HUNDRED, THOUSAND, TEN_THOUSAND, HUNDRED_THOUSAND, MILLION = "រយ", "ពាន់", "ម៉ឺន", "សែន", "លាន"
MINUS, POINT, ORDINAL = "ដក ", "ចុច", "ទី"

# fixed values: changes of fearful, breaking and suspended lines, by style
EMOTIONAL = {
    "sad_romantic": {"break_gain": -2.6, "break_rate": 0.9, "break_after": 420.0, "suspend_pause": 0.22},
    "cinematic": {"break_gain": -2.8, "break_rate": 0.89, "break_after": 430.0, "suspend_pause": 0.2},
}
FEAR = {"style": "cinematic", "emotions": ["tension", "revelation"], "gain": -3.0, "rate": 0.9, "pause": 0.25}
SUSPEND_CUES = ["ពេលណា", "ប្រហែល", "សង្ស័យ", "នឹកដល់", "រង់ចាំ", "សង្ឃឹម", "មិនដឹង", "ចង់ដឹង", "ឬមួយ"]

# fixed values: words that reveal a feeling
FEELING_CUES = {
    "sadness": ["យំ", "ទុក្ខ", "ឈឺចាប់", "ការបាត់បង់", "អស់សង្ឃឹម", "ខ្លោចផ្សា", "sad", "sadness", "tears", "cried", "crying", "sorrow"],
    "grief": ["ស្លាប់", "បាត់បង់", "ពិធីបុណ្យសព", "ផ្នូរ", "សោក", "grief", "grieving", "died", "death", "funeral", "buried", "grave", "never came back"],
    "fear": ["ខ្លាច", "ភ័យ", "រន្ធត់", "គ្រោះថ្នាក់", "រត់", "afraid", "fear", "fearful", "terrified", "scared", "danger"],
    "tension": ["ស្ងាត់", "នៅសល់", "កាំបិត", "ឈាម", "លាក់", "សម្ងាត់", "tense", "tension", "knife", "blood", "hidden", "secret", "silence"],
    "suspense": ["រង់ចាំ", "មិនដឹង", "ទ្វារ", "ស្រាប់តែ", "ងងឹត", "suspense", "waited", "door", "behind", "dark", "suddenly", "unknown"],
    "joy": ["សប្បាយ", "រីករាយ", "សើច", "ជោគជ័យ", "ញញឹម", "ពន្លឺ", "joy", "happy", "laughed", "smile", "victory", "celebrate", "light"],
    "love": ["ស្រលាញ់", "ស្រឡាញ់", "ថើប", "ឱប", "ស្នេហា", "ដៃគូ", "love", "loved", "kiss", "kissed", "hug", "held", "beloved"],
    "loneliness": ["ឯកា", "ម្នាក់ឯង", "ស្ងាត់ជ្រងំ", "គ្មាននរណា", "alone", "lonely", "empty", "no one", "nobody"],
    "regret": ["ស្តាយ", "អស់ឱកាស", "បើបាន", "ខុស", "មិនគួរ", "regret", "wish", "should have", "too late", "if only"],
    "nostalgia": ["កាលពី", "អតីតកាល", "កុមារភាព", "ថ្ងៃនោះ", "ចងចាំ", "remember", "memories", "once", "back then", "childhood", "long ago"],
    "curiosity": ["ហេតុអ្វី", "យ៉ាងដូចម្តេច", "សំណួរ", "រកឃើញ", "why", "how", "question", "wonder", "discovered", "found out"],
    "relief": ["ស្រាលចិត្ត", "ស្អាត", "រួចផុត", "សុវត្ថិភាព", "relief", "relieved", "safe", "finally", "at last", "breathed"],
    "hope": ["សង្ឃឹម", "អនាគត", "ព្រឹកថ្មី", "ជឿ", "hope", "hopeful", "tomorrow", "believe", "future", "dawn"],
    "vulnerability": ["ទន់ខ្សោយ", "ភ័យខ្លាច", "ការសារភាព", "ទឹកភ្នែក", "vulnerable", "confession", "confessed", "fragile", "barely"],
    "confidence": ["ជឿជាក់", "ឈ្នះ", "ខ្លាំង", "សម្រេច", "confident", "won", "strong", "decided", "determined"],
    "anger": ["ខឹង", "ក្តៅក្រហាយ", "ស្តីបន្ទោស", "ឈ្លោះ", "angry", "anger", "furious", "shouted", "rage"],
    "peace": ["ស្ងប់", "សន្តិភាព", "ស្ងៀម", "ដកដង្ហើម", "calm", "peace", "peaceful", "quiet", "breathe", "still"],
}

# fixed values: the emotion that performs a feeling
FEELING_EMOTION = {
    "sadness": "sad", "grief": "grieving", "fear": "fearful", "tension": "tense", "suspense": "suspense", "joy": "joyful", "love": "romantic", "loneliness": "lonely", "regret": "regretful",
    "nostalgia": "nostalgic", "curiosity": "curious", "relief": "relieved", "hope": "hopeful", "vulnerability": "heartbroken", "confidence": "confident", "anger": "angry", "peace": "calm",
}

# fixed values: which of a style's four deliveries (0 to 3) performs a feeling
FEELING_SLOT = {
    "natural": {"peace": 0, "joy": 1, "love": 1, "nostalgia": 2, "curiosity": 2, "relief": 2, "hope": 2, "sadness": 3, "vulnerability": 3, "regret": 3, "tension": 3, "fear": 3, "grief": 3},
    "storytelling": {"curiosity": 0, "hope": 0, "suspense": 1, "tension": 1, "fear": 1, "joy": 2, "peace": 2, "love": 3, "nostalgia": 3, "sadness": 3, "grief": 3, "loneliness": 3, "relief": 0},
    "novel": {"peace": 0, "joy": 0, "hope": 0, "love": 1, "sadness": 1, "fear": 1, "nostalgia": 2, "regret": 2, "grief": 3, "loneliness": 3, "vulnerability": 3, "tension": 1, "relief": 2, "curiosity": 0},
    "documentary": {"tension": 0, "curiosity": 0, "confidence": 0, "grief": 1, "regret": 1, "nostalgia": 1, "hope": 2, "joy": 2, "sadness": 3, "love": 3, "peace": 3, "fear": 0, "relief": 2},
    "trailer": {"hope": 0, "confidence": 0, "tension": 1, "fear": 1, "anger": 1, "love": 2, "sadness": 2, "grief": 2, "joy": 2, "suspense": 3, "relief": 3, "curiosity": 3, "peace": 0, "nostalgia": 2},
    "audiobook": {"peace": 0, "joy": 0, "love": 1, "hope": 1, "fear": 1, "anger": 1, "nostalgia": 2, "regret": 2, "relief": 2, "sadness": 3, "grief": 3, "tension": 3, "suspense": 3, "curiosity": 0, "loneliness": 2},
    "news": {"confidence": 0, "tension": 0, "fear": 1, "anger": 1, "hope": 1, "grief": 2, "sadness": 2, "regret": 2, "relief": 3, "peace": 3, "love": 3, "nostalgia": 3, "joy": 3, "curiosity": 0, "suspense": 1},
    "explainer": {"joy": 0, "hope": 0, "curiosity": 1, "confidence": 1, "tension": 2, "fear": 2, "suspense": 2, "regret": 2, "peace": 2, "love": 3, "relief": 3, "anger": 3, "sadness": 3, "grief": 3, "nostalgia": 2},
    "thriller": {"tension": 0, "suspense": 0, "curiosity": 0, "fear": 1, "vulnerability": 1, "loneliness": 2, "regret": 2, "nostalgia": 2, "grief": 2, "joy": 3, "sadness": 3, "anger": 3, "peace": 2, "love": 1, "hope": 1, "confidence": 1},
    "meditation": {"peace": 0, "relief": 0, "love": 1, "hope": 1, "sadness": 2, "grief": 2, "regret": 2, "nostalgia": 2, "joy": 3, "curiosity": 3, "tension": 3, "fear": 3, "loneliness": 2, "vulnerability": 2},
    "inner_monologue": {"love": 0, "vulnerability": 0, "curiosity": 0, "loneliness": 1, "peace": 1, "nostalgia": 3, "regret": 3, "sadness": 3, "grief": 3, "fear": 1, "tension": 1, "joy": 1, "hope": 1, "relief": 1, "suspense": 1},
    "sad_romantic": {"sadness": 0, "vulnerability": 0, "regret": 0, "grief": 1, "loneliness": 1, "peace": 1, "nostalgia": 2, "love": 3, "hope": 2, "relief": 3, "joy": 1, "tension": 1, "fear": 1},
    "cinematic": {"suspense": 0, "tension": 0, "love": 0, "vulnerability": 1, "peace": 1, "fear": 2, "anger": 2, "grief": 3, "sadness": 3, "regret": 3, "joy": 0, "hope": 0, "nostalgia": 0, "relief": 0},
}

# fixed values: cues that go before feelings, in order, and their slots
SPECIAL_CUES = {
    "shock": "ភ្លាមៗ|ស្រាប់តែ|suddenly|screamed|all at once|in an instant",
    "whisper": "សម្ងាត់|ខ្សឹប|ខ្សឹបខ្សៀវ|ស្និទ្ធស្នាល|secret|whisper|whispered|leaned close|close to (?:her|his|my) ear",
    "memory": "ចងចាំ|នឹក|remember|memory|memories|long ago|used to",
    "grief": "ទឹកភ្នែក|យំ|tears|crying|cried",
}
SPECIAL_SLOT = {
    "shock": {"trailer": 3, "thriller": 3, "storytelling": 1, "audiobook": 3, "cinematic": 2, "novel": 1, "natural": 3, "documentary": 0, "news": 2, "explainer": 2, "meditation": 3, "inner_monologue": 1, "sad_romantic": 1},
    "whisper": {"cinematic": 1, "inner_monologue": 0, "novel": 3, "sad_romantic": 3, "storytelling": 3, "thriller": 1, "audiobook": 1, "meditation": 1, "natural": 3, "documentary": 3, "news": 3, "explainer": 3, "trailer": 1},
    "memory": {"novel": 2, "storytelling": 3, "audiobook": 2, "sad_romantic": 2, "inner_monologue": 3, "natural": 2, "documentary": 1, "cinematic": 0, "meditation": 2, "news": 3, "explainer": 3, "trailer": 2, "thriller": 2},
    "grief": {"sad_romantic": 1, "cinematic": 3, "novel": 3, "documentary": 1, "audiobook": 3, "storytelling": 3, "thriller": 2, "natural": 3, "news": 2, "explainer": 3, "meditation": 2, "inner_monologue": 3, "trailer": 2},
}

# fixed values: the four deliveries of each style, each with what its pauses are multiplied by
DELIVERIES = {
    "natural": [("Natural / Comfortable", 0.95), ("Warm / Personal", 1.05), ("Reflective / Thoughtful", 1.2), ("Subtle Emotion", 1.08)],
    "storytelling": [("Inviting Storyteller", 1.05), ("Suspenseful Storyteller", 1.3), ("Wonder / Imagination", 1.25), ("Personal / Heartfelt", 1.2)],
    "novel": [("Immersive Emotion", 1.1), ("Character-Aware", 1.05), ("Reflective / Literary", 1.2), ("Intimate / Vulnerable", 1.28)],
    "documentary": [("Serious / Reflective", 1.2), ("Historical / Solemn", 1.45), ("Hopeful / Uplifting", 1.05), ("Human / Compassionate", 1.22)],
    "trailer": [("Powerful / Anticipatory", 1.25), ("Dark / Threatening", 1.5), ("Emotional / Epic", 1.35), ("Shock / Revelation", 1.6)],
    "audiobook": [("Immersive / Emotional", 1.08), ("Character / Feeling Driven", 1.05), ("Deep / Reflective", 1.25), ("Dramatic but Natural", 1.15)],
    "news": [("Serious / Respectful", 1.15), ("Urgent / Important", 0.8), ("Somber / Sensitive", 1.35), ("Reassuring / Stable", 1.1)],
    "explainer": [("Friendly / Helpful", 1.0), ("Curious / Engaging", 0.95), ("Reassuring / Patient", 1.25), ("Encouraging / Motivational", 1.05)],
    "thriller": [("Suspenseful", 1.45), ("Fearful / Scared", 1.5), ("Dark / Mysterious", 1.55), ("Shock / Panic", 0.85)],
    "meditation": [("Deep Calm", 1.35), ("Comforting / Reassuring", 1.3), ("Reflective / Healing", 1.4), ("Peaceful / Hopeful", 1.25)],
    "inner_monologue": [("Private / Intimate", 1.3), ("Lonely / Empty", 1.6), ("Vulnerable / Confessional", 1.45), ("Regretful / Reflective", 1.4)],
    "sad_romantic": [("Soft Heartbreak", 1.45), ("Deep Sadness", 1.6), ("Longing / Missing Someone", 1.7), ("Love Through Tears", 1.55)],
    "cinematic": [("Deep Emotional", 1.25), ("Whisper / Intimate", 1.45), ("Fear / Suspense", 1.5), ("Grief / Emotional Climax", 1.75)],
}

# fixed values: how far a delivery may move a style's pauses
PAUSE_ENVELOPE = {"news": (0.75, 1.40), "trailer": (1.10, 1.75), "meditation": (1.20, 1.70), "other": (0.75, 1.85)}

# fixed values: lines beyond which a measure of a clip counts, and the score bands (below each number)
CLIP_LINES = {"rumble": 0.02, "mud": 7.0, "presence": 0.008, "sibilance": 1.2, "wander": 10.0}
SCORE_BANDS = [(40, "poor"), (60, "needs cleanup"), (80, "moderate"), (101, "good")]

# fixed values: how far the voice's pitch (semitones), gain (dB) and pace may go
IDENTITY = {"pitch": 0.25, "gain": 0.8, "pace": (0.94, 1.06)}

# fixed values: how far up a style's band each phase of a piece stands
PHASE_SHARE = {"opening": 0.30, "build": 0.50, "turn": 0.68, "climax": 1.0, "release": 0.42, "whole": 0.5}

# fixed values: signs that are pauses, with their plain form and level
PAUSE_SIGNS = {"។": (".", 4), "៕": (".", 5), "៖": (",", 2), "៙": (".", 4), "៚": (".", 4), ".": (".", 4), "!": ("!", 4), "?": ("?", 4), ",": (",", 1), "…": ("…", 3)}

# fixed values: signs that join the word before them, and the word after them
JOIN_LEFT, JOIN_RIGHT = ".,!?;:%…)]}\"'", "([{“‘\""

# fixed values: capitalised words that are not names
NOT_NAMES = [
    "The", "A", "An", "Inside", "However", "Yet", "For", "So", "But", "When", "After", "Before", "During", "Today", "Now", "Then", "Here", "There", "This", "That", "These", "Those", "It",
    "Its", "He", "She", "They", "We", "You", "Mr", "Mrs", "Ms", "Dr", "Saint", "No", "Yes", "Well", "And", "Or", "Not", "King", "Queen", "God", "New", "Old", "Great", "First", "Last",
]

# fixed values: what two hosts say around the facts of a text
HOST_INTRO = {"title": "Welcome back, everyone. Today's episode: {}.", "sentence": "Welcome back, everyone. Today's episode starts with {} — and the story behind it.", "reply": "I've read through the material, and I have to say — there's a lot more going on here than you'd expect.", "first": "So let's start from the beginning. "}
HOST_TEASERS = {
    "number": ["There's a number in this next part that I honestly didn't believe at first.", "Hold on to this, because the next detail is a big one.", "This next part is where the scale of it all becomes obvious."],
    "name": ["The next part brings in {sal} — and it changes the whole picture.", "Coming up, we get to {sal}, which is where things start to matter.", "And then there's {sal}. I'll say no more until you hear the context."],
    "idea": ["Okay, this is the part I didn't expect.", "Which brings us to something a bit surprising.", "And now, the part of the story people usually miss."],
}
HOST_OUTRO = {
    "detail": "Here's the detail I'll leave you with: {}.", "span": "So, {} — from {} all the way to {}. That's the whole arc in two lines.", "plain": "So, {}. Big ideas, a big ending — that's the story in a nutshell.",
    "last": ["And I think that's the takeaway. Everything else in the material is just detail.", "Well, that's time for today. Thanks so much for listening.", "And thanks to all of you tuning in. See you in the next one."],
}

# fixed values: voice engines with their quality and whether they work without a network; the order in which they are tried
ENGINES = [("voxcpm", 5, True), ("edge", 4, False), ("mmsft", 3, True), ("mms", 2, True), ("gtts", 1, False)]
ENGINE_ORDER = ["edge", "mmsft", "mms", "voxcpm", "gtts"]

# fixed values: written and spoken forms of abbreviations
ABBREVIATIONS = {
    "គ.ស.": "គ្រិស្តសករាជ", "គ.ស": "គ្រិស្តសករាជ", "ព.ស.": "ពុទ្ធសករាជ", "ព.ស": "ពុទ្ធសករាជ", "ម.ស.": "មហាសករាជ", "ម.ស": "មហាសករាជ", "ច.ស.": "ចុល្លសករាជ", "ច.ស": "ចុល្លសករាជ",
    "ស.វ.": "សតវត្ស", "ស.វ": "សតវត្ស", "គ.ក.": "គីឡូក្រាម", "គ.ក": "គីឡូក្រាម", "គ.ម.": "គីឡូម៉ែត្រ", "គ.ម": "គីឡូម៉ែត្រ", "ស.ម.": "សង់ទីម៉ែត្រ", "ស.ម": "សង់ទីម៉ែត្រ",
    "ល.រ.": "លេខរៀង", "ល.រ": "លេខរៀង", "ទ.ី.": "ទី", "ព.ធ.": "ព្រះធម៌", "ព.ធ": "ព្រះធម៌",
}

# fixed values: words before a number that make it a year
YEAR_MARKERS = ["គ្រិស្តសករាជ", "ពុទ្ធសករាជ", "មហាសករាជ", "ចុល្លសករាជ", "គ.ស", "ព.ស", "ម.ស", "ច.ស", "ឆ្នាំ", "សករាជ"]

# fixed values: units that join the number before them
UNITS = [
    "ឆ្នាំ", "ខែ", "ថ្ងៃ", "ម៉ោង", "នាទី", "វិនាទី", "នាក់", "ដង", "លើក", "គ្រឿង", "ក្រុម", "គ្រួសារ", "ភាគរយ", "រៀល", "ដុល្លារ", "បាត", "យន់",
    "គីឡូក្រាម", "គីឡូម៉ែត្រ", "ម៉ែត្រ", "សង់ទីម៉ែត្រ", "លាន", "ពាន់", "រយ", "សែន", "ម៉ឺន", "គ.ម", "គ.ក", "ក្រាម", "លីត្រ", "តោន",
]

# fixed values: words that open a phrase
PHRASE_OPENERS = [
    "បន្ទាប់មក", "ក្រោយមក", "ថ្ងៃក្រោយមក", "កាលនោះ", "នៅពេលនោះ", "រហូតដល់", "ដូចនេះ", "ដូច្នេះ", "ដូចនេះហើយ", "ផ្ទុយទៅវិញ", "ប៉ុន្តែ", "តែ", "ដោយសារតែ", "ដោយសារ", "ចុងក្រោយនេះ", "ហើយ",
    "បន្ទាប់", "ក្នុងពេលនោះ", "ទោះបីជា", "ទោះជាយ៉ាងណា", "សរុបមក",
]

# fixed values: titles and names that stay whole
TITLES = ["ព្រះបាទ", "ព្រះមហាក្សត្រ", "ព្រះអង្គ", "ព្រះនាង", "ព្រះរាជបុត្រ", "ព្រះរាជវង្ស", "ព្រះរាជសម្បត្តិ", "ព្រះរាជបល្ល័ង្ក", "ព្រះអគ្គមហេសី", "ព្រះរាជា", "ស្តេច", "ព្រះសង្ឃ", "ព្រះគ្រូ", "ព្រះពុទ្ធ"]
NAMES = [
    "ជ័យវរ្ម័ន", "ជយវម៌្ម", "សូរ្យវរ្ម័ន", "ឧទយាទិត្យវរ្ម័ន", "ហរិហរាល័យ", "ឥន្ទ្រវរ្ម័ន", "យសោវរ្ម័ន", "ព្រហ្មញ្ញ", "អង្គរវត្ត", "អង្គរធំ", "បាយ័ន", "ភ្នំពេញ", "សៀមរាប", "បាត់ដំបង", "កំពង់ចាម", "ក្រុងតាខ្មៅ",
    "មេគង្គ", "ទន្លេសាប", "គ្រិស្តសករាជ", "ពុទ្ធសករាជ", "មហាសករាជ", "ចុល្លសករាជ", "សតវត្ស", "អាណាចក្រ", "ចក្រភព", "សាសនា",
]

# fixed values: words that the repetition sign repeats
REPEATED = [
    "អ្វី", "ព្រឹក", "ល្ងាច", "ថ្ងៃ", "យប់", "ដង", "ច្រើន", "តិច", "ខ្លះ", "គ្នា", "ផ្សេង", "ម្នាក់", "កន្លែង", "ពេល", "សប្តាហ៍", "ខែ", "ឆ្នាំ", "បន្តិចម្ដង", "មួយចាន", "ដោយឡែក", "សន្សឹម", "ក្មេង", "ម្តង",
    "ដូច", "យូរ", "នាក់", "គ្រឿង", "ពួក", "ក្រុម", "លើក", "ដប់", "រយ", "ពាន់", "លាន", "ធំ", "តូច", "ខ្ពស់", "ទាប", "ជិត", "ឆ្ងាយ", "លឿន", "យឺត", "ស្អាត", "ល្អ", "អាក្រក់", "ថ្លៃ", "ចាស់", "ថ្មី", "ស្រួល", "លំបាក", "ខ្លាំង",
]

# fixed values: months
MONTHS = ["មករា", "កុម្ភៈ", "មីនា", "មេសា", "ឧសភា", "មិថុនា", "កក្កដា", "សីហា", "កញ្ញា", "តុលា", "វិច្ឆិកា", "ធ្នូ"]

# fixed values: patterns of written numbers, in the order in which they are read
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
KHMER_LETTERS = "ក-៓"
WRITTEN = {
    "time": rf"(?<![\d])(\d{{1,2}}):(\d{{2}})\s*(AM|PM|am|pm)?(?![{KHMER_LETTERS}\d])",
    "day_first": r"(?<!\d)(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})(?!\d)",
    "year_first": r"(?<!\d)(\d{4})[/\-](\d{1,2})[/\-](\d{1,2})(?!\d)",
    "dollar": rf"\$\s*({NUMBER})",
    "riel": rf"({NUMBER})\s*(?:៛|រៀល)",
    "percent": rf"({NUMBER})\s*%",
    "ordinal": rf"ទី\s*({NUMBER})(?![{KHMER_LETTERS}])",
    "phone_groups": rf"(?<![\d{KHMER_LETTERS}])(\d{{3}})[ \-](\d{{3}})[ \-](\d{{3}})(?![\d{KHMER_LETTERS}])",
    "phone": rf"(?<![\d{KHMER_LETTERS}])(0\d{{7,9}})(?![\d{KHMER_LETTERS}])",
    "unit": rf"(?<![{KHMER_LETTERS}\d])({NUMBER})\s*((?:{'|'.join(u.replace('.', chr(92) + '.') for u in UNITS)}))(?![\u17b4-៓])",
    "decimal": r"(?<![\d.])(\d+)\.(\d+)(?![\d])",
    "number": r"(?<![\d.,])(\d{1,15})(?![\d.,])",
}

# fixed values: patterns of marks in a line that are not read, in order
LINE_MARKS = [(r"^\s*#{1,6}\s*", ""), (r"\s*#{1,6}\s*$", ""), (r"(\*\*|__)(.+?)\1", r"\2"), (r"`([^`]*)`", r"\1"), (r"^\s*[•●▪–—\-\*]\s+", ""), (r"^\s*(?:\d{1,3}|[០-៩]{1,3})[.)]\s+", "")]
FORMAT_LINE = r"^\s*(?:[-=*_#~]{3,}|#{1,6}\s*.*|```.*)\s*$"
SHORT_FORM = r"(?<![.។-៙])([ក-អ](?:\.[ក-អ]){1,4}\.?)(?![ក-អ])"

# fixed values: what the plain number reader says otherwise
PLAIN_SEVENTY, PLAIN_POINT = "ចិត្តសិប", "ចំណុច"

# fixed values: the deliveries' emphasis, breath, rhythm, sentence ending and lift, in the order of DELIVERIES
MOVES = {
    "Natural / Comfortable": (0.35, 0.2, "flowing", "natural fall", 0.0),
    "Warm / Personal": (0.45, 0.3, "smooth", "natural fall", 0.1),
    "Reflective / Thoughtful": (0.35, 0.25, "reflective", "reflective release", -0.1),
    "Subtle Emotion": (0.4, 0.35, "hesitant", "soft fall", 0.05),
    "Inviting Storyteller": (0.55, 0.3, "flowing", "natural fall", 0.05),
    "Suspenseful Storyteller": (0.6, 0.25, "tense", "suspended ending", 0.15),
    "Wonder / Imagination": (0.6, 0.3, "spacious", "gentle rise", 0.1),
    "Personal / Heartfelt": (0.55, 0.45, "reflective", "soft fall", 0.1),
    "Immersive Emotion": (0.45, 0.25, "flowing", "natural fall", 0.05),
    "Character-Aware": (0.45, 0.3, "smooth", "soft fall", 0.05),
    "Reflective / Literary": (0.4, 0.25, "reflective", "reflective release", -0.05),
    "Intimate / Vulnerable": (0.4, 0.5, "hesitant", "soft fall", -0.1),
    "Serious / Reflective": (0.35, 0.15, "reflective", "firm ending", -0.05),
    "Historical / Solemn": (0.3, 0.15, "spacious", "reflective release", -0.2),
    "Hopeful / Uplifting": (0.45, 0.25, "smooth", "gentle rise", 0.15),
    "Human / Compassionate": (0.4, 0.35, "reflective", "soft fall", -0.05),
    "Powerful / Anticipatory": (0.85, 0.15, "tense", "firm ending", 0.2),
    "Dark / Threatening": (0.6, 0.2, "tense", "suspended ending", 0.1),
    "Emotional / Epic": (0.9, 0.25, "spacious", "emotionally weakened ending", 0.25),
    "Shock / Revelation": (0.8, 0.3, "hesitant", "suspended ending", 0.2),
    "Immersive / Emotional": (0.45, 0.25, "flowing", "natural fall", 0.05),
    "Character / Feeling Driven": (0.45, 0.3, "smooth", "soft fall", 0.1),
    "Deep / Reflective": (0.4, 0.3, "reflective", "reflective release", -0.05),
    "Dramatic but Natural": (0.65, 0.25, "flowing", "firm ending", 0.15),
    "Serious / Respectful": (0.35, 0.0, "smooth", "firm ending", -0.05),
    "Urgent / Important": (0.5, 0.0, "urgent", "firm ending", 0.2),
    "Somber / Sensitive": (0.3, 0.15, "reflective", "reflective release", -0.15),
    "Reassuring / Stable": (0.35, 0.1, "smooth", "natural fall", 0.0),
    "Friendly / Helpful": (0.4, 0.2, "smooth", "natural fall", 0.05),
    "Curious / Engaging": (0.45, 0.25, "flowing", "gentle rise", 0.1),
    "Reassuring / Patient": (0.35, 0.25, "spacious", "soft fall", -0.05),
    "Encouraging / Motivational": (0.55, 0.2, "flowing", "firm ending", 0.2),
    "Suspenseful": (0.6, 0.25, "tense", "suspended ending", 0.1),
    "Fearful / Scared": (0.45, 0.55, "hesitant", "suspended ending", 0.05),
    "Dark / Mysterious": (0.55, 0.3, "spacious", "suspended ending", 0.05),
    "Shock / Panic": (0.7, 0.6, "urgent", "firm ending", 0.25),
    "Deep Calm": (0.25, 0.2, "spacious", "reflective release", -0.1),
    "Comforting / Reassuring": (0.3, 0.3, "smooth", "soft fall", -0.05),
    "Reflective / Healing": (0.25, 0.35, "reflective", "reflective release", -0.05),
    "Peaceful / Hopeful": (0.3, 0.25, "spacious", "gentle rise", 0.05),
    "Private / Intimate": (0.35, 0.45, "hesitant", "soft fall", -0.05),
    "Lonely / Empty": (0.25, 0.4, "spacious", "emotionally weakened ending", -0.15),
    "Vulnerable / Confessional": (0.35, 0.6, "hesitant", "soft fall", 0.05),
    "Regretful / Reflective": (0.35, 0.4, "reflective", "reflective release", 0.0),
    "Soft Heartbreak": (0.35, 0.5, "hesitant", "soft fall", -0.05),
    "Deep Sadness": (0.3, 0.45, "reflective", "emotionally weakened ending", -0.15),
    "Longing / Missing Someone": (0.4, 0.5, "spacious", "soft fall", -0.05),
    "Love Through Tears": (0.4, 0.65, "hesitant", "emotionally weakened ending", 0.05),
    "Deep Emotional": (0.55, 0.35, "flowing", "natural fall", 0.1),
    "Whisper / Intimate": (0.45, 0.7, "hesitant", "soft fall", 0.0),
    "Fear / Suspense": (0.6, 0.5, "tense", "suspended ending", 0.15),
    "Grief / Emotional Climax": (0.45, 0.6, "spacious", "emotionally weakened ending", 0.1),
}

# fixed values: of each emotion the pitch band, span, rate band, energy band, pause factor, breath, tension, push and family
EMOTION_FIELDS = "emotion pitch0 pitch1 span rate0 rate1 energy0 energy1 pause breath tension push family".split()
EMOTIONS = [
    ("neutral", 0.0, 0.3, 1.2, 0.98, 1.02, -0.5, 0.5, 1.0, 0.1, 0.15, 0.3, "calm"),
    ("calm", -0.7, 0.0, 0.9, 0.92, 0.98, -1.6, -0.4, 1.2, 0.14, 0.08, 0.15, "calm"),
    ("warm", 0.1, 0.8, 1.6, 0.94, 1.0, -1.0, 0.6, 1.08, 0.2, 0.1, 0.3, "calm"),
    ("tender", 0.2, 1.0, 1.4, 0.88, 0.96, -2.2, -0.6, 1.28, 0.34, 0.06, 0.2, "tender"),
    ("affectionate", 0.4, 1.3, 1.8, 0.92, 1.0, -1.4, 0.4, 1.12, 0.26, 0.08, 0.34, "tender"),
    ("compassionate", -0.4, 0.6, 1.5, 0.9, 0.98, -1.8, -0.2, 1.18, 0.24, 0.12, 0.26, "tender"),
    ("reverent", -1.0, -0.1, 1.1, 0.86, 0.94, -2.0, -0.6, 1.35, 0.18, 0.1, 0.2, "solemn"),
    ("solemn", -1.2, -0.2, 1.0, 0.84, 0.92, -1.8, -0.2, 1.4, 0.12, 0.2, 0.22, "solemn"),
    ("mysterious", -1.4, -0.3, 1.3, 0.84, 0.93, -2.2, -0.6, 1.45, 0.3, 0.18, 0.24, "mystery"),
    ("joyful", 0.8, 2.2, 2.6, 1.02, 1.12, 0.4, 2.2, 0.86, 0.16, 0.12, 0.72, "bright"),
    ("playful", 0.6, 2.0, 2.8, 1.0, 1.12, 0.2, 1.8, 0.84, 0.18, 0.1, 0.68, "bright"),
    ("amused", 0.3, 1.6, 2.2, 0.98, 1.08, -0.2, 1.4, 0.92, 0.22, 0.1, 0.55, "bright"),
    ("hopeful", 0.3, 1.5, 2.0, 0.96, 1.04, -0.6, 1.0, 1.02, 0.18, 0.12, 0.48, "bright"),
    ("proud", 0.2, 1.2, 1.8, 0.94, 1.02, 0.0, 1.6, 1.06, 0.12, 0.26, 0.6, "bright"),
    ("inspired", 0.4, 1.8, 2.4, 0.96, 1.06, -0.2, 1.8, 1.0, 0.16, 0.2, 0.7, "bright"),
    ("triumphant", 0.6, 2.4, 3.0, 0.96, 1.08, 0.8, 2.8, 1.1, 0.1, 0.32, 0.86, "bright"),
    ("relieved", -0.2, 0.8, 2.0, 0.94, 1.04, -0.8, 0.8, 1.12, 0.26, 0.06, 0.34, "bright"),
    ("informative", 0.0, 0.5, 1.4, 0.98, 1.05, -0.6, 0.6, 1.05, 0.1, 0.14, 0.44, "informative"),
    ("formal", -0.4, 0.2, 1.1, 0.96, 1.02, -0.8, 0.4, 1.1, 0.08, 0.2, 0.4, "informative"),
    ("curious", 0.2, 1.2, 2.0, 0.98, 1.08, -0.6, 0.8, 0.98, 0.16, 0.12, 0.52, "informative"),
    ("thoughtful", -0.6, 0.2, 1.4, 0.9, 0.98, -1.6, -0.2, 1.26, 0.18, 0.12, 0.22, "informative"),
    ("conclusive", -0.3, 0.4, 1.3, 0.94, 1.0, -0.2, 1.2, 1.22, 0.1, 0.24, 0.62, "informative"),
    ("determined", 0.0, 1.0, 1.5, 0.98, 1.06, 0.2, 1.8, 0.94, 0.08, 0.4, 0.78, "driven"),
    ("confident", -0.1, 0.7, 1.4, 0.96, 1.03, -0.2, 1.2, 1.02, 0.08, 0.3, 0.62, "driven"),
    ("urgent", 0.2, 1.4, 1.8, 1.06, 1.16, 0.4, 2.2, 0.72, 0.14, 0.46, 0.92, "driven"),
    ("nostalgic", -0.8, 0.3, 1.6, 0.88, 0.96, -2.0, -0.4, 1.3, 0.28, 0.1, 0.22, "tender"),
    ("wistful", -1.0, 0.1, 1.5, 0.86, 0.94, -2.2, -0.6, 1.34, 0.3, 0.08, 0.18, "tender"),
    ("longing", -0.4, 0.6, 1.9, 0.86, 0.95, -2.0, -0.2, 1.3, 0.34, 0.16, 0.28, "tender"),
    ("romantic", 0.1, 1.1, 1.9, 0.87, 0.95, -2.0, -0.2, 1.26, 0.36, 0.14, 0.3, "tender"),
    ("bittersweet", -0.6, 0.5, 1.8, 0.88, 0.96, -1.9, -0.1, 1.28, 0.3, 0.14, 0.26, "tender"),
    ("melancholic", -1.2, -0.1, 1.3, 0.84, 0.93, -2.4, -0.8, 1.38, 0.28, 0.12, 0.16, "sad"),
    ("sad", -1.2, -0.2, 1.4, 0.84, 0.93, -2.2, -0.6, 1.34, 0.3, 0.18, 0.18, "sad"),
    ("grieving", -1.6, -0.4, 1.6, 0.78, 0.9, -2.6, -0.8, 1.5, 0.4, 0.34, 0.14, "sad"),
    ("heartbroken", -1.8, -0.5, 1.8, 0.76, 0.9, -2.6, -0.6, 1.5, 0.42, 0.38, 0.14, "sad"),
    ("regretful", -1.3, -0.3, 1.5, 0.82, 0.92, -2.3, -0.7, 1.42, 0.32, 0.2, 0.16, "sad"),
    ("lonely", -1.4, -0.4, 1.2, 0.8, 0.9, -2.6, -1.0, 1.52, 0.38, 0.14, 0.12, "sad"),
    ("exhausted", -1.5, -0.4, 1.1, 0.8, 0.9, -2.6, -1.0, 1.48, 0.44, 0.06, 0.1, "sad"),
    ("anxious", 0.2, 1.4, 2.2, 1.02, 1.14, -1.0, 0.8, 0.86, 0.34, 0.52, 0.66, "fear"),
    ("worried", -0.2, 0.9, 1.9, 0.94, 1.06, -1.2, 0.4, 1.1, 0.3, 0.46, 0.48, "fear"),
    ("fearful", 0.6, 2.0, 2.6, 1.0, 1.14, -0.6, 1.4, 0.92, 0.44, 0.64, 0.72, "fear"),
    ("terrified", 1.0, 3.0, 3.4, 1.04, 1.2, 0.2, 2.4, 0.78, 0.5, 0.8, 0.9, "fear"),
    ("tense", 0.0, 1.0, 1.4, 0.92, 1.02, -0.8, 1.0, 1.16, 0.22, 0.72, 0.58, "fear"),
    ("suspense", -0.6, 0.6, 1.4, 0.8, 0.92, -1.8, 0.2, 1.55, 0.24, 0.66, 0.3, "fear"),
    ("dread", -1.4, -0.2, 1.3, 0.78, 0.9, -2.2, -0.2, 1.6, 0.3, 0.7, 0.24, "fear"),
    ("angry", 0.6, 2.0, 2.4, 1.0, 1.12, 0.8, 2.6, 0.82, 0.1, 0.78, 0.88, "anger"),
    ("frustrated", 0.2, 1.4, 2.0, 0.96, 1.08, 0.0, 1.8, 0.92, 0.16, 0.62, 0.7, "anger"),
    ("defiant", 0.4, 1.6, 2.0, 0.96, 1.06, 0.4, 2.2, 1.0, 0.1, 0.58, 0.84, "anger"),
    ("desperate", 0.2, 1.8, 2.4, 0.94, 1.1, -0.6, 1.6, 0.94, 0.42, 0.66, 0.76, "anger"),
    ("surprised", 0.6, 2.2, 2.8, 1.0, 1.12, 0.0, 1.8, 0.94, 0.24, 0.3, 0.7, "awe"),
    ("awed", 0.2, 1.6, 2.2, 0.84, 0.94, -1.0, 1.0, 1.36, 0.28, 0.16, 0.34, "awe"),
    ("revelation", -0.2, 1.2, 1.8, 0.8, 0.92, -0.8, 1.2, 1.62, 0.18, 0.34, 0.4, "awe"),
    ("epic", 0.0, 1.4, 2.2, 0.88, 0.98, 0.0, 2.2, 1.3, 0.14, 0.3, 0.66, "awe"),
]

# fixed values: the emotion of a style where nothing says more, and the one it turns to
STYLE_EMOTION = {"natural": "neutral", "storytelling": "warm", "novel": "thoughtful", "documentary": "informative", "trailer": "epic", "audiobook": "warm", "news": "formal", "explainer": "informative", "thriller": "suspense", "meditation": "calm", "inner_monologue": "thoughtful", "sad_romantic": "romantic", "cinematic": "bittersweet"}
TURN_EMOTION = {"natural": "surprised", "storytelling": "curious", "novel": "tense", "documentary": "revelation", "trailer": "triumphant", "audiobook": "thoughtful", "news": "informative", "explainer": "conclusive", "thriller": "fearful", "meditation": "awed", "inner_monologue": "longing", "sad_romantic": "heartbroken", "cinematic": "heartbroken"}

# fixed values: words that turn a sentence, and how
SHIFT_MARKERS = {"ប៉ុន្តែ": "turn", "តែ": "turn", "ផ្ទុយទៅវិញ": "turn", "ផ្ទុយមកវិញ": "turn", "ទោះបីជា": "turn", "ទោះជាយ៉ាងណា": "turn", "យ៉ាងណាក៏ដោយ": "turn", "ដូច្នេះ": "result", "ហេតុនេះ": "result", "ព្រោះ": "result", "ដោយសារតែ": "result", "ដោយសារ": "result", "សរុបមក": "result", "ចុងក្រោយ": "result", "ក្រោយមក": "result", "បន្ទាប់មក": "result", "ស្រាប់តែ": "shock", "ភ្លាមៗ": "shock", "មិនគួរឱ្យជឿ": "shock", "ជាការពិត": "confirm", "ពិតប្រាកដ": "confirm", "ការពិត": "confirm", "ហើយ": "add"}

# fixed values: words to stress, and words never stressed
STRESS_WORDS = ["ស្លាប់", "ឈឺចាប់", "ស្រលាញ់", "ស្រឡាញ់", "ចងចាំ", "អាណិត", "ខឹង", "ភ័យ", "ខ្លាច", "សង្ឃឹម", "អស់សង្ឃឹម", "ឈ្នះ", "ចាញ់", "បាត់បង់", "រកឃើញ", "ពិត", "កុហក", "ដ៏អស្ចារ្យ", "អស្ចារ្យ", "គ្រោះថ្នាក់", "សង្គ្រាម", "សន្តិភាព", "ឯករាជ្យ", "ដ៏ធំ", "ដ៏ខ្ពស់", "ដ៏ស្រស់ស្អាត", "នឹក", "យំ", "ញញឹម", "ព្រះ", "អច្ឆរិយៈ", "អាថ៌កំបាំង", "ជ័យជម្នះ"]
NO_STRESS = ["និង", "ឬ", "ដែល", "ដោយ", "នៅ", "ក្នុង", "លើ", "ក្រោម", "ពី", "ទៅ", "មក", "គឺ", "ជា", "នេះ", "នោះ", "បាន", "នឹង", "ក៏"]

# fixed values: of each style the pitch it stands at and may move by (semitones), whether strength raises or lowers it, how strongly phrases are set off,
# what an ending and dialogue add to the pitch, and its label
STYLE_PITCH = {
    "natural": (0.0, 0.8, 1, 0.25, -0.4, 0.3, "Natural read"),
    "storytelling": (0.2, 2.2, 1, 0.55, -1.0, 0.9, "Narrative Storytelling"),
    "novel": (-0.3, 1.4, 1, 0.4, -0.6, 0.9, "Novel Narration"),
    "documentary": (-0.6, 0.9, 1, 0.45, -0.7, 0.2, "Documentary"),
    "trailer": (-2.6, 1.6, -1, 0.85, -1.8, 0.5, "Movie trailer"),
    "audiobook": (-0.2, 1.2, 1, 0.4, -0.5, 0.8, "Audiobook"),
    "news": (-0.4, 0.7, 1, 0.3, -0.3, 0.0, "News anchor"),
    "explainer": (0.0, 1.3, 1, 0.5, -0.4, 0.4, "Explainer"),
    "thriller": (-1.8, 0.9, -1, 0.6, -1.4, -0.4, "Thriller"),
    "meditation": (-1.0, 0.5, 1, 0.15, -0.4, 0.0, "Meditation"),
    "inner_monologue": (-1.0, 1.2, 1, 0.5, -0.9, 0.3, "Inner Monologue"),
    "sad_romantic": (-1.2, 1.0, 1, 0.6, -1.1, 0.2, "Sad Romantic"),
    "cinematic": (-1.6, 1.8, 1, 0.75, -1.3, 1.0, "Emotional Cinematic Storytelling"),
}

# fixed values: words that two styles set off beside the cue words
OWN_STRESS = {
    "sad_romantic": ["អ្នក", "ខ្ញុំ", "យើង", "ធ្លាប់", "នៅតែ", "មិនដែល", "ម្តងទៀត", "ចងចាំ", "បាត់", "ផ្ទះ", "ម្នាក់ឯង", "ស្អែក", "លាហើយ", "អតីតកាល", "ស្នេហ៍"],
    "cinematic": ["សំឡេង", "ទ្វារ", "ខ្មៅ", "ខ្លាច", "លាក់", "អាថ៌កំបាំង", "ស្ងាត់", "ម្នាក់ឯង", "ចងចាំ", "ស្រមោល", "ញាប់ញ័រ", "ភ្លេច", "ស្នេហ៍", "ជីវិត"],
}

# fixed values: the delivery slot of a phase, and the feeling that an emotion belongs to beside FEELING_EMOTION
PHASE_SLOT = {"opening": 0, "build": 1, "turn": 2, "climax": 3, "release": 1}
EMOTION_FEELING = {
    "terrified": "fear", "tender": "love", "affectionate": "love", "wistful": "nostalgia", "determined": "confidence", "frustrated": "anger", "defiant": "anger", "neutral": "peace", "warm": "love", "compassionate": "love",
    "melancholic": "sadness", "bittersweet": "sadness", "longing": "love", "thoughtful": "peace", "reverent": "peace", "solemn": "grief", "mysterious": "suspense", "anxious": "fear", "worried": "fear", "dread": "fear",
    "desperate": "vulnerability", "exhausted": "sadness", "surprised": "shock", "awed": "hope", "revelation": "shock", "epic": "confidence", "proud": "confidence", "inspired": "hope", "triumphant": "confidence",
    "amused": "joy", "playful": "joy", "informative": "curiosity", "formal": "confidence", "conclusive": "confidence", "urgent": "tension",
}

# fixed values: words that name an emotion where a sentence has no sign of its own, in order; the second name is for the two emotional styles
SENTENCE_CUES = [("ស្លាប់|បាត់បង់|យំ|ឈឺចាប់", "sad", "grieving"), ("ខ្លាច|ភ័យ|គ្រោះថ្នាក់", "fearful", "fearful"), ("ស្រលាញ់|ស្រឡាញ់|ចងចាំ|នឹក", "tender", "romantic"), ("ឈ្នះ|ជ័យជម្នះ|ជោគជ័យ", "triumphant", "triumphant")]
DENIALS = "មិន|គ្មាន|កុំ|ហាម"

# fixed values: what two hosts say around the paragraphs of a Thai and a Khmer text: openings, hand-overs by the host who speaks them, closings
PARAGRAPH_HOSTS = {
    "th": {
        "open": ["ยินดีต้อนรับสู่รายการของเรา วันนี้เรามาคุยกันเรื่อง {}", "ใช่แล้ว เรื่องนี้มีอะไรมากกว่าที่คิดเยอะ"],
        "B": ["น่าสนใจเลย แล้วต่อจากนั้นเป็นอย่างไร", "ไม่คาดคิดเลย แล้วเรื่องจบลงอย่างไร", "ตรงนี้สำคัญมากเลย เล่าต่อเลยครับ", "แล้วต่อจากนั้นเกิดอะไรขึ้น", "มาเจาะลึกตรงนี้กันเถอะ", "เล่าให้ฟังต่อเลย"],
        "A": ["แล้วตรงนี้แหละที่เริ่มสนุก ต่อจากนั้นเกิดอะไรขึ้น", "ผมต้องรู้ต่อว่าเรื่องนี้เป็นอย่างไร", "นี่คือส่วนที่คนส่วนใหญ่ไม่รู้ ต่อเลย", "มาฟังกันต่อว่าเกิดอะไรขึ้น", "แล้วเรื่องก็เดินทางมาถึงตรงนี้", "ฟังกันต่อครับ แล้วต่อจากนั้นเป็นอย่างไร"],
        "close": ["หมดเวลาสำหรับวันนี้ ขอบคุณที่รับฟังนะครับ", "พบกันใหม่ครั้งหน้า แล้วเจอกัน"],
    },
    "km": {
        "open": ["សូមស្វាគមន៍មកកាន់កម្មវិធីរបស់យើង។ ថ្ងៃនេះយើងនិយាយគ្នាអំពី {}", "បាទ រឿងនេះមានអ្វីៗច្រើនជាងដែលគិតទុក។"],
        "B": ["ចាប់អារម្មណ៍ណាស់។ តើបន្ទាប់មកមានអ្វីកើតឡើងទៀត?", "ខ្ញុំមិនបានគិតទេ។ តើរឿងនេះបញ្ចប់យ៉ាងដូចម្តេច?", "ចំណុចនេះសំខាន់ណាស់។ សូមបន្តទត។", "បន្ទាប់ពីនោះ មានអ្វីកើតឡើងទៀត?", "យើងមកស្វែងយល់បន្តិចទៀត។", "សូមរៀបរាប់បន្តទត។"],
        "A": ["ហើយនៅចំណុចនេះហើយ រឿងចាប់ផ្តើមរីកចម្រើន។ តើបន្ទាប់មកកើតឡើងអ្វី?", "ខ្ញុំត្រូវដឹងបន្ថែមថា រឿងនេះដំណើរការយ៉ាងដូចម្តេច។", "នេះជាផ្នែកដែលអ្នកភាគច្រើនមិនដឹង។ សូមបន្ត។", "សូមស្តាប់បន្តទត។", "ហើយរឿងកមកដល់ចំណុចនេះ។", "សូមស្តាប់បន្តទត។ តើបន្ទាប់មកមានអ្វីកើតឡើងទៀត?"],
        "close": ["ពេលវេលាចប់សម្រាប់ថ្ងៃនេះ។ សូមអរគុណសម្រាប់ការស្តាប់។", "ជួបគ្នាម្តងទៀតនៅពេលក្រោយ។"],
    },
}

# fixed values: settings of the voice clone, with the limits of its numbers and the choices of its names
CLONE_SETTINGS = {"rvcDir": "", "python": "", "model": "assets/weights/voice.pth", "index": "", "pitch": 0.0, "indexRate": 0.75, "protect": 0.33, "f0Method": "rmvpe", "carrier": "km-KH-SreymomNeural", "scope": "khmer"}
CLONE_LIMITS = {"pitch": (-12.0, 12.0), "indexRate": (0.0, 1.0), "protect": (0.0, 0.7)}
CLONE_CHOICES = {"f0Method": ["rmvpe", "harvest", "crepe", "pm"], "scope": ["khmer", "all"]}

# fixed values: expressive gain of each style, in dB and seconds; styles whose last value is False are written down but switched off
EXPRESSIVE = {
    # swell, beat, ease, presence on the beat, presence everywhere, seconds of easing, step between sentences, least words, on
    "cinematic": (1.35, 0.45, -2.30, 1.50, 0.35, 0.42, 0.35, 5, True),
    "bedtime": (0.45, 0.10, -2.15, 0.0, 0.0, 0.60, 0.15, 4, True),
    "storytelling": (0.55, 0.0, -1.10, 0.70, 0.15, 0.34, 0.25, 5, False),
    "novel": (0.40, 0.0, -1.00, 0.45, 0.10, 0.30, 0.20, 5, False),
    "sad_romantic": (0.50, 0.0, -1.70, 0.40, 0.10, 0.48, 0.20, 5, False),
    "inner_monologue": (0.40, 0.0, -1.30, 0.35, 0.10, 0.40, 0.18, 4, False),
    "meditation": (0.25, 0.0, -1.40, 0.0, 0.0, 0.60, 0.10, 4, False),
    "trailer": (1.60, 0.0, -0.90, 1.30, 0.20, 0.30, 0.45, 4, False),
}

# fixed values: bounds of swell, beat, ease, presence on the beat and everywhere
EXPRESSIVE_BOUNDS = ((0.0, 2.0), (0.0, 1.0), (-3.0, 0.0), (0.0, 2.5), (0.0, 1.0))
# fixed values: the presence band in Hz
PRESENCE_BAND = (2200.0, 5200.0)
