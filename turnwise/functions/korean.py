"""Fixed values of the written-to-spoken rules and of code switching.

Rules are applied in this order, a later one to what earlier ones made.
"""

VERB_ENDINGS = [
    ("합니다$", "해요"),
    ("합니까\\?$", "해요?"),
    ("입니다$", "이에요"),
    ("입니까\\?$", "인가요?"),
    ("습니다$", "어요"),
    ("습니까\\?$", "을까요?"),
    ("하겠습니다$", "할게요"),
    ("드리겠습니다$", "드릴게요"),
    ("되겠습니다$", "될 거예요"),
    ("있습니다$", "있어요"),
    ("없습니다$", "없어요"),
    ("됩니다$", "돼요"),
    ("싶습니다$", "싶어요"),
    ("봅니다$", "봐요"),
    ("갑니다$", "가요"),
    ("옵니다$", "와요"),
    ("줍니다$", "줘요"),
    ("봅시다$", "봐요"),
    ("갑시다$", "가요"),
    ("합시다$", "해요"),
]
CONTRACTIONS = [
    ("것은", "건"),
    ("것이", "게"),
    ("것을", "걸"),
    ("그것", "그거"),
    ("이것", "이거"),
    ("저것", "저거"),
    ("무엇", "뭐"),
    ("어디에", "어디"),
    ("왜냐하면", "왜냐면"),
    ("그러므로", "그래서"),
    ("그렇지만", "근데"),
    ("그러나", "근데"),
    ("따라서", "그래서"),
    ("하지만", "근데"),
]
SUBJECT_CONTRACTIONS = [("나는", "난"), ("너는", "넌"), ("저는", "전"), ("그는", "걔는"), ("그녀는", "걔는"), ("우리는", "우린")]
PHRASES = [
    ("하지 않", "안 하"),
    ("되지 않", "안 되"),
    ("알겠습니다", "알겠어요"),
    ("감사합니다", "고마워요"),
    ("죄송합니다", "미안해요"),
    ("모르겠습니다", "모르겠어요"),
    ("괜찮습니다", "괜찮아요"),
    ("그렇습니다", "그래요"),
    ("아닙니다", "아니에요"),
    ("맞습니다", "맞아요"),
    ("~하시겠습니까", "~할래요?"),
    ("부탁드립니다", "부탁해요"),
    ("말씀드리다", "말하다"),
]
FILLERS = ["음", "그", "아", "어", "저"]
TECH_TERMS = {
    "인공지능": "AI",
    "응용프로그램": "application",
    "애플리케이션": "app",
    "서버": "server",
    "데이터베이스": "database",
    "사용자 인터페이스": "UI",
    "사용자 경험": "UX",
    "프로그래밍": "programming",
    "알고리즘": "algorithm",
    "기계학습": "machine learning",
    "딥러닝": "deep learning",
    "클라우드": "cloud",
    "인터넷": "internet",
    "웹사이트": "website",
    "소프트웨어": "software",
    "하드웨어": "hardware",
}
SPOKEN_RULES = VERB_ENDINGS + CONTRACTIONS + SUBJECT_CONTRACTIONS + PHRASES
