"""Fixed values shared by the text operators, in plain text and natural order."""

#: Very common words of running prose, by language.
COMMON_WORDS = {
    "en": "the a an of and to in is was it that for on with as at by from be are were had has have this which not but or if when where who what there their they he she his her its we you i my our your so than then no nor neither only both until because after before about again into over under near while would should can will one two some other",
    "de": "der die das den dem des ein eine einen einem einer und oder in im am an auf aus mit von vom zu zum zur ist war sind wird wurde nicht auch als wie bis noch nach für es er sie wir ihr ich sich da dass weil wenn ohne unter über vor bei um so man nur alle hat hatte seit",
    "fr": "le la les un une des du de et ou à au aux en dans sur sous par pour avec sans est était sont fut a ont ne pas plus que qui quoi ce cette ces il elle ils nous vous je se sa son ses leur y comme si mais avant après depuis encore",
    "es": "el la los las un una unos unas de del y o a al en con sin por para que se es era son fue no más su sus lo le nos como si pero hasta desde tras ya todo esta este cuando donde porque sobre bajo entre otras",
    "ru": "и в на не что как с по это из у за от до для о же но а так к мы он она они я вы их его её был была было бы если когда где без после перед ещё всё через под",
    "ar": "في من على إلى أن هذا هذه كان ما لا عن مع ثم قد إن لم هو هي كل بعد قبل صار هل هنا حتى ليس",
    "hi": "के का की में ने को से है और पर यह वह तो ही भी कि था थी हैं नहीं एक हो लगती मिला छोड़ दिया लिया",
    "am": "ነው እና ላይ ውስጥ ስለ ወደ ከ አለ በኋላ ምናልባት በመጨረሻ ማንም እዚህ",
}
#: Endings and particles that mark running text where words aren't set apart.
COMMON_SIGNS = {
    "ja": "の を が に は で と も た だ し な い て る から まで",
    "zh": "的 了 是 在 有 和 不 这 那 还 之 后 前 为 把 被",
    "ko": "은 는 이 가 을 를 에 의 도 다 로 고 하",
    "th": "ที่ ใน ไม่ จึง ก็ และ กับ มี ของ เป็น ว่า จาก ถ้า ยัง",
}
#: Marks that end a sentence, and those that may follow and still belong to it.
SENTENCE_ENDS = ".!?…。！？．｡؟۔।॥።፧៕"
CLOSING_MARKS = "\"'”’»›」』）】〕〉》)]}＂＇｣"
