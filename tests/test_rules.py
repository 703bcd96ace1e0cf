"""Every rule against the same pattern under Python's re: full-width, ideographic spaces and mixed case included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.operators.detect import rule_spans
from maskloom.operators.rules import PROFILES

PIECES = """電話 TEL Tel tel : ： 　 | 090-1234-5678 090　1234　5678 ０３　１２３４　５６７８ +81-90-1234-5678 o9o-1234-5678 0OI-1234-567l
〒100-0001 １００－０００１ 〒１００　０００１ 192.168.0.1 １.2.3.4 x10.0.0.1 a.b@Example.co.jp ａ＠ｂ．ｃｏ sk-ABCDEFGHIJ12 SK-abcdefghij12 api_keykey123 Tok-abcdef12 Bearer　abcdef99
パスワードは秘密abc。 password:Secret12 Password:Secret12 PASSWORD:Secret12 口座番号は1234567 口座番号：７６５４３２１ 普通　1234567 普通1234567 普通oil1234 当座OIl1234 123456789012 １２３４５６７８９０１２
大阪市北区梅田1-2-3本社 東京都港区芝公園一丁目 神奈川県横浜市西区１－２ 住所：北町村12 My name is John Smith MY NAME IS JOHN SMITH 名前は山田太郎 担当は　鈴木 山田さん 氏名：山田　太郎 山田 太郎様 佐藤　花子 さん
2月3日10時 １２月３１日２３時 西部研究所 大阪工場 の森です 株式会社北方 有限会社みらい電機 北方商事株式会社 取引先：東洋産業 委託先は西部研究所 振込先：青空銀行 青空信用金庫 担当者：田中一郎 連絡者は 高橋
name=john.doe Person=Jane_D user=x1 Name：Mary Ann-Lee Contact: Bob O'Neil 氏名カナ:ヤマダタロウ 会社名：株式会社ABC社 住所：東京都港区芝1-2-3 電話:0901234 森 南 API メール カナ:サトウハナコ 第1条 ſk ＡＢＣ""".split("\n")


def texts():
    pieces = [p for line in PIECES for p in line.split(" ")]
    rng = random.Random(4)
    out = [" ".join(x) for x in zip(pieces, pieces[1:])] + pieces
    for _ in range(400):
        out.append("".join(rng.choice(pieces) + rng.choice(["", "", " ", "　", "。", "は"]) for _ in range(rng.randrange(1, 9))))
    return out


@pytest.mark.parametrize("profile", ["japanese", "url", "word", "slide", "page_names", "legacy", "ocr"])
def test_rules_equal_python(spark, profile):
    rules, given = PROFILES[profile], texts()
    df = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    got = {r.id: [(x.rule, x.start, x.end, x.text) for x in r.spans] for r in df.select("id", rule_spans(F.col("text"), rules).alias("spans")).collect()}
    for i, text in enumerate(given):
        want = []
        for n, rule in enumerate(rules):
            flags = re.IGNORECASE if "i" in rule.flags else 0
            for m in re.finditer(rule.pattern, text, flags):
                want.append((n, *m.span(rule.group), m.group(rule.group)))
        assert got[i] == want, text
