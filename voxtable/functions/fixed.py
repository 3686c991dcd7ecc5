"""Word lists, label menus, thresholds and the card schema.

Everything in this file is data that results depend on; nothing here computes anything.
All times are microseconds, all levels dBFS.
"""

# --- fixed values: contraction spellings after punctuation is removed -------------------------
CONTRACTIONS = {
    "theres": "there", "thats": "that", "whats": "what", "heres": "here",
    "lets": "let", "youre": "you", "theyre": "they", "im": "i",
}

# --- fixed values: stop lists, one per purpose (they differ on purpose) ------------------------
STOP_RETAKE = (
    "a an the is it its of to in on at or and so but for with as be was were are this that these "
    "those i you we they he she if then than just can could will would should do does did not no "
    "yes up out now there here your my our by from have has had what when how"
).split()
STOP_TAKES = "a an the is it of to in on and so for as be i you we that this now your or".split()
STOP_VERIFY = (
    "a an the and or but so if then than that this these those is are was were be been being am "
    "i you he she it we they me him her us them my your his its our their to of in on at by for "
    "with from as into about up down out over just not no do does did done have has had can could "
    "will would should may might must there here what which who whom whose when where why how all "
    "any each some such very too also only own same other more most like get got one s t don't it's "
    "you're i'm that's let's"
).split()
STOP_EMPHASIS = (
    "a an the is it of to in on at or and so but for with as be was were are this that these those "
    "i you we they he she if then than just can could will would should do does did not no yes up "
    "out one two three big way"
).split()
STOP_GIANT = (
    "the and but that this with have from you your are was for not can will just its they them "
    "then than when what were been"
).split()
STOP_TITLE = (
    "the a an and or but so to of in on at for with is are was were be it this that you your i we "
    "they he she as by from not no do does did have has had will would can could just very"
).split()
FILLER_SPOKEN = "um uh umm uhh uhm erm hmm mmm".split()
FILLER_STRUCTURE = "um uh er ah so and like you know".split()
STOP_STRUCTURE = (
    "a an the is are was were be been being to of in on at for with or but if as that this these "
    "those it its it's i i'd i'm i'll you're he she we we're they them my your his her our their do "
    "does did don't doesn't didn't have has had will would can could should not no up down out about "
    "into than then there here what which who whom get got going gonna just really very well okay "
    "right mean thing things stuff few lot lots way ways bit bits kind kinds sort sorts part parts "
    "something someone somewhere anything anyone everything everyone"
).split()
CLAUSE_STARTERS = (
    "and but so because which then whereas when while if once after before until since although or "
    "now first second third finally next"
).split()
DANGLING = (
    "a an the to of in on at for with by from into onto as and or but so that this these those your "
    "my our their its is are was were be it's i you we they if than then like can will would could "
    "should do does did not no very just all"
).split()

# --- fixed values: classifier label menus, in menu order --------------------------------------
MENUS = {
    "overlay": "none card keyword_pill giant_word".split(),
    "camera": "base punch face_closeup push_in drift".split(),
    "template": (
        "big_statement stamp keyword_pill stat_number versus option_chips confidence_meter yes_no "
        "scale_slider numbered_point checklist chat_bubble definition icon_row code_terminal "
        "flow_steps dual_stat quote"
    ).split(),
    "text_effect": (
        "typewriter word_pop slide_up blur_in scramble_decode highlighter_swipe scale_punch mask_reveal"
    ).split(),
    "transition": "hard_cut flash whip_streak glass_wipe zoom_blur glitch_slice".split(),
    "sfx": "none whoosh pop ding riser impact".split(),
    "caption_style": (
        "word_pop single_word karaoke_line boxed_highlight typewriter_line anton_karaoke archivo_chip "
        "inter_editorial"
    ).split(),
    "style_family": (
        "apple_glass bold_kinetic terminal_type neon_cyber paper_editorial clean_swiss gradient_pop dark_luxe"
    ).split(),
    "accent": "blue green yellow orange red pink purple cyan".split(),
    "hook_style": "giant_word giant_number giant_question focus_word ghost_topic".split(),
}
SOUND_TYPES = "whoosh pop ding riser impact".split()
UNDER_CHIN_TEMPLATES = "big_statement stamp keyword_pill stat_number".split()
NO_HOLD_TEMPLATES = "numbered_point stamp keyword_pill".split()
REVEAL_TEMPLATES = "yes_no scale_slider confidence_meter option_chips".split()

# --- fixed values: card schema (template, field, kind, required, max_words, min_len, max_len, enum) ---
_S, _E, _N, _A, _I = "string", "enum", "number", "stringArray", "iconArray"
CARD_SCHEMA = [
    ("big_statement", "text", _S, True, 5, None, None, None),
    ("big_statement", "sub", _S, False, 5, None, None, None),
    ("stamp", "text", _S, True, 3, None, None, None),
    ("stamp", "tone", _E, True, None, None, None, ["negative", "positive", "neutral"]),
    ("keyword_pill", "text", _S, True, 3, None, None, None),
    ("keyword_pill", "emoji", _S, False, 1, None, None, None),
    ("stat_number", "value", _S, True, 3, None, None, None),
    ("stat_number", "unit", _S, False, 2, None, None, None),
    ("stat_number", "label", _S, True, 5, None, None, None),
    ("versus", "left", _S, True, 5, None, None, None),
    ("versus", "right", _S, True, 5, None, None, None),
    ("versus", "leftSub", _S, False, 5, None, None, None),
    ("versus", "rightSub", _S, False, 5, None, None, None),
    ("versus", "winner", _E, False, None, None, None, ["left", "right"]),
    ("option_chips", "question", _S, False, 5, None, None, None),
    ("option_chips", "options", _A, True, None, 2, 5, None),
    ("option_chips", "pickedIndex", _N, True, None, None, None, None),
    ("option_chips", "confidencePct", _N, False, None, None, None, None),
    ("confidence_meter", "label", _S, True, 5, None, None, None),
    ("confidence_meter", "pct", _N, True, None, None, None, None),
    ("yes_no", "question", _S, True, 5, None, None, None),
    ("yes_no", "answer", _E, True, None, None, None, ["yes", "no"]),
    ("yes_no", "pct", _N, True, None, None, None, None),
    ("scale_slider", "question", _S, False, 5, None, None, None),
    ("scale_slider", "labels", _A, True, None, 2, 5, None),
    ("scale_slider", "value", _N, True, None, None, None, None),
    ("scale_slider", "valueLabel", _S, False, 3, None, None, None),
    ("numbered_point", "number", _S, True, 1, None, None, None),
    ("numbered_point", "title", _S, True, 5, None, None, None),
    ("numbered_point", "sub", _S, False, 5, None, None, None),
    ("checklist", "title", _S, False, 5, None, None, None),
    ("checklist", "items", _A, True, None, 2, 4, None),
    ("chat_bubble", "from", _S, False, 2, None, None, None),
    ("chat_bubble", "message", _S, True, 14, None, None, None),
    ("definition", "term", _S, True, 3, None, None, None),
    ("definition", "meaning", _S, True, 10, None, None, None),
    ("icon_row", "items", _I, True, None, 2, 4, None),
    ("code_terminal", "lines", _A, True, None, 1, 4, None),
    ("flow_steps", "steps", _A, True, None, 2, 4, None),
    ("dual_stat", "leftValue", _S, True, 3, None, None, None),
    ("dual_stat", "leftLabel", _S, True, 5, None, None, None),
    ("dual_stat", "rightValue", _S, True, 3, None, None, None),
    ("dual_stat", "rightLabel", _S, True, 5, None, None, None),
    ("quote", "text", _S, True, 14, None, None, None),
    ("quote", "by", _S, False, 3, None, None, None),
]

# --- fixed values: thresholds (microseconds unless the name says otherwise) --------------------
FRAME_US = 10_000                    # one level row
RETAKE_WORDS, RETAKE_US = 60, 30_000_000
TAKE_SNAP_US = 250_000               # pause that can open a take
TAKE_BOUNDARY_US = 200_000
PHRASE_GAP_US = 500_000
CHUNK_GAP_US = 350_000
CHAIN_ACCEPT, MEMBER_ACCEPT = 0.4, 0.5
FALLBACK_STRENGTH, FALLBACK_STUTTER = 5, 3
QUESTIONS_PER_REQUEST = 64
CONTEXT_WORDS, RESULT_WORDS = 24, 40
FILLER_AIR_US = 30_000
FILLER_MIN_US, FILLER_MAX_US, FILLER_CLEAR_US = 150_000, 1_200_000, 50_000
RECOVER_MIN_US, RECOVER_PAD_US, RECOVER_GAP_US = 600_000, 300_000, 1_000_000
PROTECT_MIN_US = 1_200_000
SPAN_SLACK_US, ECHO_US = 200_000, 350_000
EDGE = {"onset": (30.0, -55.0, -45.0), "offset": (22.0, -52.0, -40.0)}   # below peak, floor, ceiling (dB)
EDGE_HOLD_FRAMES = 7
LONG_WORD_US = 450_000
SOFT_GAP_FRAMES, SOFT_RUN_FRAMES, SOFT_SLACK_US, SOFT_STEPS = 30, 3, 40_000, 6
MIN_WORD_US = 40_000
REFINE_SLACK_US, REFINE_SLIDE_US = 20_000, 600_000
MAX_GAP_US = 350_000
PAD_AFTER_US, PAD_BEFORE_US = 80_000, 50_000
PHRASE_PAD_AFTER_US, PHRASE_PAD_BEFORE_US = 50_000, 40_000
EDGE_MARGIN_US, MIN_CUT_US = 30_000, 50_000
VOICED_DB, VOICED_FRAMES = -45.0, 3
MIN_OVERLAP_US = 20_000
VISIBLE_CUT_US, CUT_COLLAPSE_US = 200_000, 1_500_000
RESTATED_US, RESTATED_APART, PHRASE_AGAIN_US, NEAR_RESTATED_US = 15_000_000, 2, 20_000_000, 8_000_000
SHOT_TARGET_S, SHOT_MIN_S, SHOT_MAX_S, SHOT_LOOKBACK_US, SHOT_TAIL_US = 2.5, 1.4, 3.0, 6_600_000, 1_000_000
SECTION_TARGET_US, SECTION_MAX_US = 8_000_000, 12_000_000
HOLD_UNDER_CHIN_US, HOLD_SPLIT_US, HOLD_MIDDLE_US = 5_500_000, 3_400_000, 2_500_000
GIANT_GAP_US, GIANT_AFTER_HOOK_US, GIANT_EVERY_US = 8_500_000, 1_500_000, 14_000_000
COVERAGE_CAP, DEAD_RUN_US = 0.55, 6_000_000
LIFT_P, LIFT_MEAN = 0.01, 0.03
TRANSITION_GAP_US, NEAR_CUT_US, TRANSITION_CONF = 5_000_000, 400_000, 0.4
SOUND_GAP_US, SOUND_CONF, SOUND_GAIN_DB = 2_500_000, 0.45, -16
PUNCH_MIN = 0.6
MIN_SPLIT_RUN_US, MIN_FULL_RUN_US = 2_500_000, 1_500_000
HOOK_MIN_US, HOOK_MAX_US, HOOK_DEFAULT_US = 2_400_000, 4_200_000, 3_000_000
FLASH_GAP_US, FLASH_MAX, FLASH_FALLBACK_US, FLASH_FALLBACK_MAX = 4_000_000, 4, 8_000_000, 3
ANIMATED_US, ANIMATED_TAIL_US = 1_500_000, 300_000
MAX_CAPTION_STYLES = 4
INPUT_PRICE_PER_MILLION = 0.042
ZOOM_PUNCH, ZOOM_CLOSEUP, FACE_FIT, FLIP_GAP = 1.28, 1.5, 1.25, 0.06
ZOOM_PUSH, ZOOM_DRIFT, DRIFT_ANCHOR = (1.0, 1.16), (1.08, 1.16), (0.3, 0.7)
DROP_SHARE, TWIN_SHARE, SLIP_WORDS, SLIP_TWIN_WORDS, SCRAP_WORDS = 0.25, 0.5, 2, 3, 12
ALT_SHARED, ALT_BETWEEN_WORDS, ALT_US, ALT_PARTNER_WORDS = 2, 8, 15_000_000, 20
HEARD_MIN_SHARE, LOOK_AHEAD = 0.6, 3
MIN_COVERAGE, MIN_GOOD_FRAMES = 0.06, 0.8
FACE_RELIABLE = 0.3
