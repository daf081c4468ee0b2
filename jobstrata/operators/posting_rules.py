"""The classifier's rules for postings of data work: a vocabulary of its own, over the fields t (title), b (body) and x (both).

The order of rules and steps is the specification. `unknown` is what no rule decides; nothing is rejected for what isn't there.
"""

from __future__ import annotations

from .cascade import Has, Holds, Ladder, Rule, Said, Several


def _has(field: str, *phrases: str) -> Has:
    return Has(field, phrases)


def _lacks(field: str, *phrases: str) -> Has:
    return Has(field, phrases, absent=True)


def _any(value: str, fields: str, *phrases: str) -> tuple[Rule, ...]:
    return tuple(Rule(value, (_has(f, *phrases),)) for f in fields)


_CLASSES = {
    "data_science": ("data scientist", "machine learning", "statistician"),
    "data_engineering": ("data engineer", "pipelines", "warehouse"),
    "analytics": ("analyst", "dashboards"),
    "software": ("developer", "software engineer"),
    "operations": ("site reliability", "on call"),
    "sales": ("account executive", "quota"),
    "support": ("helpdesk", "tickets"),
    "people": ("recruiter", "payroll"),
}
#: CLS-02: what the source's taxonomy says, then the title, then the last part of a compound.
OFF_INDUSTRY = Ladder("off_industry", (Rule("taxonomy", (Said("category", ("care", "teaching")),)), Rule("title", (_has("t", "nurse", "teacher", "driver"),)), Rule("compound", (Holds("compound IS NOT NULL"),))), None)
#: CLS-03: all categories in the title, the body-safe ones in the body, too.
EXCLUSIONS = Several("exclusions", (*_any("unpaid", "tb", "unpaid", "volunteer"), *_any("agency", "tb", "staffing agency"), *_any("commission", "t", "commission only"), *_any("security_clearance", "b", "clearance required"), *_any("franchise", "t", "franchise")))
#: CLS-04: eight ordered classes, in the title first, then in everything.
ROLE_CLASS = Ladder("role_class", tuple(Rule(v, (_has("t", *p),)) for v, p in _CLASSES.items()) + tuple(Rule(v, (_has("x", *p),)) for v, p in _CLASSES.items()))
#: CLS-05
STYLE = Ladder("style", (Rule("research", (_has("x", "experiments", "publications"), _lacks("x", "production"))), Rule("applied", (_has("x", "production", "deploy"),))), "unstated")
#: CLS-06
DESK = Ladder("desk", (Rule("front", (_has("x", "clients", "product team"),)), Rule("middle", (_has("x", "risk", "reporting"),)), Rule("back", (_has("x", "payroll", "ledger"),))), "unstated")
#: CLS-10
HORIZON = Several("horizon", (*_any("realtime", "tb", "streaming", "real time"), *_any("daily", "tb", "nightly", "daily batch"), *_any("quarterly", "tb", "quarterly"), *_any("yearly", "tb", "annual")))
#: CLS-11: a gate is void where the text takes it back.
GATES = Several("hard_gates", (Rule("citizenship", (_has("b", "citizens only"), _lacks("b", "or permanent residents"))), Rule("clearance", (_has("b", "clearance required"),)), Rule("doctorate", (Holds("doctorate_only"),)), Rule("licence", (_has("b", "driving licence required"),)), Rule("onsite", (_has("b", "five days on site"), _lacks("b", "no relocation needed")))))
#: CLS-12: each language in each frame.
_FRAMES = ("fluent {}", "native {}", "{} is required", "business level {}", "you speak {}")
LANGUAGES = ("german", "french", "spanish", "swedish", "danish", "italian")
SPOKEN = Several("spoken_language", tuple(r for lang in LANGUAGES for r in _any(lang, "x", *[f.format(lang) for f in _FRAMES])))
#: CLS-14 before years are counted; an officer of another kind is no executive.
RUNGS = ("intern", "junior", "mid", "senior", "lead", "executive")
SENIORITY = Ladder(
    "rung",
    (Rule("executive", (_has("t", "chief", "vice president"), _lacks("t", "assistant to the chief", "compliance officer"))), Rule("lead", (_has("t", "head of", "lead", "principal"),)), Rule("senior", (_has("t", "senior", "staff"),)), Rule("intern", (Holds("student_title"),)), Rule("junior", (_has("t", "junior", "graduate"),)), Rule("mid", (_has("t", "experienced"),)), Rule("senior", (_has("b", "seasoned professional"),))),
)
#: CLS-16
CODE_DEPTH = Ladder("code_depth", (Rule("systems", (_has("x", "cplusplus", "rust"),)), Rule("engineering", (_has("x", "software engineer", "pipelines"),)), Rule("scripting", (_has("x", "python", "r scripts"),)), Rule("query", (_has("x", "sql"),)), Rule("none", (_has("x", "no coding"),))), "unstated")
#: CLS-17: a student's title is an internship whatever the body says.
CONTRACT = Ladder("contract", (Rule("internship", (Holds("student_title"),)), Rule("internship", (_has("x", "internship"),)), Rule("fixed_term", (_has("x", "fixed term", "temporary"),)), Rule("freelance", (_has("x", "freelance"),)), Rule("permanent", (_has("x", "permanent"),))), "unstated")
#: CLS-18
TOOLS = Several("language", tuple(Rule(v, (_has("x", p),)) for v, p in (("python", "python"), ("sql", "sql"), ("scala", "scala"), ("cpp", "cplusplus"), ("csharp", "csharp"), ("rust", "rust"))))
#: CLS-19: cities, then what is left of a country; of places without either nothing is known.
CITIES = {"stockholm": "sweden", "malmo": "sweden", "berlin": "germany", "munich": "germany", "paris": "france"}
HUB = Several("hub", tuple(Rule(c, (_has("l", c),)) for c in CITIES) + tuple(Rule(c, (_has("l", c),)) for c in dict.fromkeys(CITIES.values())))
#: CLS-07: the first branch that fits decides.
RELEVANCE = Ladder(
    "relevance",
    (
        Rule("rejected", (Holds("off_industry IS NOT NULL"),)),
        Rule("rejected", (Holds("n_exclusions > 0"), Said("role_class", ("sales", "support", "people", "unknown")))),
        Rule("less_relevant", (Holds("n_exclusions > 0"),)),
        Rule("rejected", (Said("role_class", ("people",)),)),
        Rule("adjacent", (Said("role_class", ("sales", "support")), _has("x", "data platform"))),
        Rule("rejected", (Said("role_class", ("sales", "support")),)),
        Rule("relevant", (Said("role_class", ("data_science", "data_engineering")), Said("style", ("research", "applied")))),
        Rule("relevant", (Said("role_class", ("data_science",)),)),
        Rule("less_relevant", (Said("role_class", ("data_engineering", "analytics")),)),
        Rule("less_relevant", (Said("role_class", ("software",)), Said("code_depth", ("systems", "engineering")))),
        Rule("adjacent", (Said("role_class", ("software", "operations")),)),
        Rule("relevant", (Holds("NOT has_body AND quant_board"),)),
    ),
)
#: CLS-08: what the class alone says.
BY_CLASS = Ladder("by_class", (Rule("adjacent", (Said("role_class", ("sales", "support", "people")),)), Rule("less_relevant", (Said("role_class", ("analytics", "software", "operations")),)), Rule("relevant", (Said("role_class", ("unknown",), never=True),))))
#: CLS-21
OUT_OF_REACH = Ladder("out_of_reach", (Rule("management", (_has("t", "chief", "head of"),)), Rule("compound", (Holds("compound IS NOT NULL"),)), Rule("seniority", (Said("seniority", ("executive", "lead")),))), None)
#: CLS-22: a family buried in the body counts unless the title or the tools say otherwise.
DIFFERENT = Ladder("different_field", (Rule("marketing", (_has("b", "marketing campaigns"), Said("role_class", ("data_science", "data_engineering"), never=True), _lacks("x", "python"))), Rule("facilities", (_has("b", "facilities"), Said("role_class", ("data_science", "data_engineering"), never=True), _lacks("x", "python")))), None)
#: CLS-23: the duties, not the text around them, say what the work is.
SCOPE = Ladder("scope", (Rule("support", (_has("d", "answer tickets", "reset passwords"), _lacks("d", "build", "model"))), Rule("finance", (_has("d", "ledger"), _lacks("d", "build", "model")))), None)
#: CLS-27: the role says it, else the body does.
CORROBORATED = Ladder("corroborated", (Rule("role", (_has("t", "data", "machine learning"),)), Rule("body", (_has("b", "data platform", "machine learning"),))), None)
#: CLS-25: nine steps, each a reason; VERDICTS has what a reason means.
JUDGED = Ladder(
    "reason",
    (
        Rule("off_industry", (Holds("off_industry IS NOT NULL"),)),
        Rule("excluded", (Holds("n_exclusions > 0"),)),
        Rule("scope", (Holds("scope IS NOT NULL"),)),
        Rule("different_field", (Holds("different_field IS NOT NULL"),)),
        Rule("out_of_reach", (Holds("out_of_reach IS NOT NULL"),)),
        Rule("relevant", (Said("relevance", ("relevant",)), Holds("corroborated IS NOT NULL"))),
        Rule("near", (Said("relevance", ("relevant", "less_relevant")),)),
        Rule("adjacent", (Said("relevance", ("adjacent",)),)),
        Rule("irrelevant", (Said("relevance", ("rejected",)),)),
    ),
    "silent",
)
VERDICTS = {"relevant": "keep", "near": "keep", "adjacent": "undecided", "silent": "undecided"}
#: CLS-24: each notch takes one step; only the first four are steps.
FITS = ("apply_now", "strong", "plausible", "stretch")
NOTCHES = ("size(hard_gates) > 0", "size(spoken_language) > 0", "off_location", "seniority IN ('senior', 'lead', 'executive')")

FIRST = (OFF_INDUSTRY, EXCLUSIONS, ROLE_CLASS, STYLE, DESK, HORIZON, GATES, SPOKEN, SENIORITY, CODE_DEPTH, CONTRACT, TOOLS, HUB)
LAST = (RELEVANCE, BY_CLASS, OUT_OF_REACH, DIFFERENT, SCOPE, CORROBORATED, JUDGED)
