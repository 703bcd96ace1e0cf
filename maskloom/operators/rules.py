"""Detection rules by profile. Patterns, kinds and scores are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.generalise import PREFECTURE


@dataclass(frozen=True)
class Rule:
    """``group`` is the part of a match that is the span; it ends the match, or begins it (``leads``). Classes are those
    of Unicode; ``flags`` also say whether case is ignored. ``needs`` is a quick pattern that a text with any match
    contains."""

    category: str
    pattern: str
    score: float
    group: int = 0
    name: str = ""
    flags: str = "(?iU)"
    needs: str = ""
    leads: bool = False


_TAIL = r"[一-龯ぁ-んァ-ヶー0-9０-９\-－一二三四五六七八九十百千丁目番地号の]+"

EMAIL = Rule("JP_EMAIL", r"[A-Za-z0-9._%+\-Ａ-Ｚａ-ｚ０-９．＿％＋－]+[@＠][A-Za-z0-9.\-Ａ-Ｚａ-ｚ０-９．－]+[.．][A-Za-zＡ-Ｚａ-ｚ]{2,}", 0.94, flags="", needs="[@＠]")
IPV4 = Rule("JP_IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.90, flags="(?U)", needs=r"(?U)\d\.\d")
POSTAL = Rule("JP_POSTAL_CODE", r"(?:〒\s*[0-9０-９]{3}[-－]?[0-9０-９]{4}|[0-9０-９]{3}[-－][0-9０-９]{4})", 0.88, flags="(?U)", needs="〒|[0-9０-９]{3}[-－][0-9０-９]")
PERSONAL_NUMBER = Rule("JP_PERSONAL_NUMBER", r"(?<![A-Za-z0-9０-９])[0-9０-９]{12}(?![A-Za-z0-9０-９])", 0.87, flags="", needs="[0-9０-９]{12}")

DIRECT = (
    EMAIL,
    Rule("JP_PHONE", r"(?:\+81[\s\-－]?(?:[0０])?(?:[1-9１-９]|[7７][0０]|[8８][0０]|[9９][0０])[\s\-－]?[0-9０-９]{2,4}[\s\-－]?[0-9０-９]{4}|[0０](?:[7７][0０]|[8８][0０]|[9９][0０])[\s\-－]?[0-9０-９]{4}[\s\-－]?[0-9０-９]{4}|[0０][0-9０-９]{1,4}[\s\-－][0-9０-９]{2,4}[\s\-－][0-9０-９]{4})", 0.93),
    POSTAL,
    Rule("JP_API_KEY", r"(?:sk-[A-Za-z0-9_-]{10,}|api[_-][A-Za-z0-9_-]{6,}|secret[_-][A-Za-z0-9_-]{6,}|tok[_-][A-Za-z0-9_-]{6,}|Bearer\s+[A-Za-z0-9_-]{6,})", 0.92),
    Rule("JP_PASSWORD", r"(?<=パスワードは)[^、。\s]+", 0.90),
    IPV4,
    Rule("JP_BANK_ACCOUNT", r"(?:(?<=口座番号は)|(?<=口座番号[:：])|(?<=普通\s)|(?<=当座\s))[0-9０-９]{7}", 0.89),
    PERSONAL_NUMBER,
    Rule("JP_ADDRESS", r"(?:大津市|名古屋市中区|大阪市北区|静岡市駿河区|高山市|札幌市中央区)[一-龯ぁ-んァ-ヶー0-9０-９一二三四五六七八九十百千丁目番地号の\-－]*(?:本社)?", 0.73),
    Rule("JP_NAME", r"(?:My name is|名前は|氏名は|担当は|名義は)\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[ァ-ヶー]{2,}(?:[ 　]+[ァ-ヶー]{2,})|[一-龯々〆ヵヶ]{1,4}(?:[ 　]*[一-龯々〆ヵヶ]{1,5})?)", 0.83, 1),
    Rule("JP_NAME", r"[一-龯々〆ヵヶ]{1,4}さん", 0.68),
    Rule("JP_SCHEDULE", r"[0-9０-９]{1,2}月[0-9０-９]{1,2}日[0-9０-９]{1,2}時", 0.72),
    Rule("JP_ORGANIZATION", r"[一-龯々〆ヵヶぁ-んァ-ヶーA-Za-z0-9 ]{1,16}(?:工場|研究所|センター|支店|本社)", 0.76),
    Rule("JP_NAME", r"(?<=の)[一-龯々〆ヵヶ]{1,3}(?=です)", 0.62),
)

NAMES = (
    Rule("JP_NAME", r"(?:氏名|名前|お名前|顧客名|患者名|社員名|担当者|宛名|申請者|利用者|名義)\s*[:：]\s*([一-龯々〆ヵヶぁ-んァ-ヶー]{1,8}(?:[ 　]+[一-龯々〆ヵヶぁ-んァ-ヶー]{1,8})?)", 0.86),
    Rule("JP_NAME", r"([一-龯々〆ヵヶ]{1,4}[ 　]+[一-龯々〆ヵヶ]{1,5})\s*(?:様|さん|殿|氏)", 0.74),
)
ADDRESSES = (
    Rule("JP_ADDRESS", rf"〒?\s*[0-9０-９]{{3}}[-－]?[0-9０-９]{{4}}\s*(?:{PREFECTURE}){_TAIL}", 0.88),
    Rule("JP_ADDRESS", rf"(?:{PREFECTURE}){_TAIL}", 0.82),
    Rule("JP_ADDRESS", rf"(?:住所は|住所[:：]|所在地[:：]|送付先[:：]|連絡先[:：]|に)?[一-龯ぁ-んァ-ヶー]{{1,10}}(?:市|区|町|村){_TAIL}", 0.68),
)
URL = (
    Rule("JP_EMAIL", EMAIL.pattern, 0.92, name="url_email"),
    Rule("JP_NAME", r"(?:name|person|user|contact)=([A-Za-z][A-Za-z.\-_%]{2,60})", 0.45, 1, name="url_name"),
)
DESIGNATORS = ("株式会社", "有限会社", "合同会社", "医療法人", "学校法人", "社会福祉法人")
SUFFIX_DESIGNATORS = ("株式会社", "有限会社", "合同会社")
_CHARS = "一-龯々〆ヵヶぁ-んァ-ヶーA-Za-z0-9"
WORD = (
    Rule("会社名", rf"(?:{'|'.join(DESIGNATORS)})[{_CHARS}]{{2,24}}", 0.88, name="word_company_prefix", flags="(?U)"),
    Rule("会社名", rf"[{_CHARS}]{{2,30}}(?:{'|'.join(SUFFIX_DESIGNATORS)})", 0.86, name="word_company_suffix", flags="(?U)"),
    Rule("会社名", rf"(?:組織として|取引先(?:として|は)?|販売先(?:として|は)?|委託先(?:として|は)?|共同研究先(?:として|は)?)\s*([{_CHARS}]{{2,20}}(?:ラボ|研究所|センター|支店|本社|工場))", 0.72, 1, "word_contextual_organization", "(?U)"),
    Rule("会社名", rf"(?:会社名|法人名|取引先|顧客企業)[:：]\s*([{_CHARS}]{{2,24}})", 0.82, 1, "word_company_label", "(?U)"),
    Rule("銀行名", rf"(?:銀行名|金融機関|振込先|口座)[:：は\s]*([{_CHARS}]{{2,20}}(?:銀行|信用金庫|信用組合))", 0.90, 1, "word_bank_label", "(?U)"),
    Rule("銀行名", rf"([{_CHARS}]{{2,20}}(?:銀行|信用金庫|信用組合))", 0.86, 1, "word_bank_name", "(?U)"),
    Rule("氏名", r"([一-龯々〆ヵヶ]{1,4}[ 　]+[一-龯々〆ヵヶ]{1,5})", 0.70, 1, "word_japanese_full_name_space", "(?U)"),
    Rule("氏名", r"(?:担当者|連絡者|確認者|責任者|代表者)\s*[:：は]\s*([一-龯々〆ヵヶ]{2,6})(?![ 　])", 0.76, 1, "word_person_role_label", "(?U)"),
)
SLIDE = tuple(Rule(r.category, r.pattern, r.score, r.group, r.name.replace("word_", "pptx_"), r.flags) for r in WORD)
PAGE_NAMES = (
    Rule("JP_NAME", r"(?:氏名|Name|NAME)\s*[:：]\s*([A-Za-z][A-Za-z .'-]{2,60})", 1.0, 1, "page_english_name", "(?U)"),
    Rule("JP_NAME", r"(?:担当者|Contact)\s*[:：]\s*([A-Za-z][A-Za-z .'-]{2,60})", 1.0, 1, "page_english_contact", "(?U)"),
)
_LEGACY_TAIL = r"[一-龯ぁ-んァ-ヶー0-9０-９\-－丁目番地号の\s　、,\.．]+"
LEGACY = (
    Rule("Address", rf"〒?\s*\d{{3}}-?\d{{4}}\s*(?:{PREFECTURE})?{_LEGACY_TAIL}", 1.0, name="legacy_postal", flags="(?U)"),
    Rule("Address", rf"(?:{PREFECTURE}){_LEGACY_TAIL}", 1.0, name="legacy_prefecture", flags="(?U)"),
    Rule("Address", rf"[一-龯ぁ-んァ-ヶー]+(?:市|区|町|村){_LEGACY_TAIL}", 1.0, name="legacy_city", flags="(?U)"),
    Rule("Name", r"(?:氏名|名前|お名前|顧客名|患者名|社員名|担当者|宛名|申請者|利用者|名義)\s*[:：]\s*([一-龯々〆ヵヶぁ-んァ-ヶー]{1,8}(?:[ 　]+[一-龯々〆ヵヶぁ-んァ-ヶー]{1,8})?)", 1.0, 1, "legacy_label", "(?U)"),
    Rule("Name", r"([一-龯々〆ヵヶ]{1,4}[ 　]+[一-龯々〆ヵヶ]{1,5})\s*(?:様|さん|殿|氏)", 1.0, 1, "legacy_honorific", "(?U)", leads=True),
)
_END = "(?=氏名|氏名カナ|カナ|会社名|法人名|住所|所在地|電話|TEL|メール|口座|API|パスワード|森|南|$)"
OCR = (
    Rule("メールアドレス", r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 1.0, 1, "auto", "(?U)"),
    Rule("APIキー", r"(sk-[A-Za-z0-9_-]{10,}|api[_-]?[A-Za-z0-9_-]{8,}|secret[_-]?[A-Za-z0-9_-]{8,}|tok[_-]?[A-Za-z0-9_-]{8,})", 1.0, 1, "auto", "(?iU)"),
    Rule("電話番号", r"(?:電話|TEL|Tel|tel)[:：]?([0O][0-9OIl]{1,3}[-ー−－]?[0-9OIl]{3,4}[-ー−－]?[0-9OIl]{4})", 1.0, 1, "auto", "(?U)"),
    Rule("銀行口座", r"(?:普通|当座)([0-9OIl]{7})", 0.5, 1, "review", "(?U)"),
    Rule("氏名", rf"(?:氏名|名前)[:：]?([一-龯々〆ヵヶ]{{2,8}}?){_END}", 0.5, 1, "review", "(?U)"),
    Rule("氏名カナ", rf"(?:氏名カナ|カナ)[:：]?([ァ-ヶー]{{4,16}}?){_END}", 0.5, 1, "review", "(?U)"),
    Rule("会社名", rf"(?:会社名|法人名)[:：]?((?:株式会社|有限会社|合同会社)[{_CHARS}]{{2,24}}?){_END}", 0.5, 1, "review", "(?U)"),
    Rule("住所", rf"(?:住所|所在地)[:：]?((?:東京都|北海道|京都府|大阪府|[一-龯]{{2,3}}県)[一-龯々〆ヵヶぁ-んァ-ヶー0-9\-ー−－]{{4,40}}?){_END}", 0.5, 1, "review", "(?U)"),
    Rule("パスワード", r"(?:パスワード|password|Password)[:：]?([A-Za-z0-9!#$%&@_\-]{6,})", 0.5, 1, "review", "(?U)"),
    Rule("氏名候補", r"([一-龯々〆ヵヶ]{1,3}さん)", 0.5, 1, "review", "(?U)"),
)
PROFILES = {
    "plain": (EMAIL, IPV4, POSTAL, PERSONAL_NUMBER),
    "direct": DIRECT,
    "japanese": (*DIRECT, *ADDRESSES, *NAMES),
    "url": URL,
    "word": WORD,
    "slide": SLIDE,
    "page_names": PAGE_NAMES,
    "legacy": LEGACY,
    "ocr": OCR,
}

# Labels and alias kinds of the categories.
LABELS = {
    "JP_NAME": "氏名", "JP_ADDRESS": "住所", "JP_COMPANY": "会社名", "JP_PHONE": "電話番号", "JP_EMAIL": "メールアドレス",
    "JP_POSTAL_CODE": "郵便番号", "JP_PERSONAL_NUMBER": "個人番号", "JP_BANK_ACCOUNT": "銀行口座", "JP_API_KEY": "APIキー",
    "JP_PASSWORD": "パスワード", "JP_IP_ADDRESS": "IPアドレス", "JP_SCHEDULE": "予定日時", "JP_ORGANIZATION": "組織名",
}
KINDS = {
    "JP_NAME": "name", "JP_ADDRESS": "address", "JP_COMPANY": "company", "JP_EMAIL": "email", "JP_PHONE": "phone",
    "JP_POSTAL_CODE": "postal_code", "JP_PERSONAL_NUMBER": "personal_number", "JP_BANK_ACCOUNT": "bank_account",
    "JP_API_KEY": "secret", "JP_PASSWORD": "secret", "JP_IP_ADDRESS": "ip", "JP_SCHEDULE": "schedule",
    "JP_ORGANIZATION": "organization",
}
NOISE_NAMES = ("電話", "メール", "住所", "境界語", "秘密情報", "不完全情報", "不正形式")
