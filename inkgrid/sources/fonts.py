"""The font registry as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Registered names with file and face, in order.
FONTS = [
    ("仿宋 (FangSong)", "simfang.ttf", 0),
    ("宋体 (SimSun)", "simsun.ttc", 0),
    ("黑体 (SimHei)", "simhei.ttf", 0),
    ("楷体 (KaiTi)", "simkai.ttf", 0),
    ("等线 (DengXian)", "Deng.ttf", 0),
    ("微软雅黑 (MSYH)", "msyh.ttc", 0),
    ("STSong (华文宋体)", "STSong.ttf", 0),
    ("Songti SC", "Songti.ttc", 0),
    ("PingFang SC", "PingFang.ttc", 0),
    ("Hiragino Sans GB W3", "Hiragino Sans GB.ttc", 0),
    ("Hiragino Sans GB W6", "Hiragino Sans GB.ttc", 2),
    ("Noto Serif CJK SC", "NotoSerifCJKsc.ttc", 0),
    ("Noto Sans CJK SC", "NotoSansCJKsc.ttc", 0),
    ("Source Han Serif SC", "SourceHanSerifSC.otf", 0),
    ("Source Han Sans SC", "SourceHanSansSC.otf", 0),
    ("WenQuanYi Zen Hei", "wqy-zenhei.ttc", 0),
]
# Keywords of the default font, most wanted first.
PREFERRED = ["仿宋", "宋体", "STSong", "Noto Serif", "Source Han Serif", "Songti", "Hiragino", "楷体", "PingFang", "黑体", "等线", "雅黑", "Noto Sans", "Source Han Sans", "WenQuanYi"]
# Font folders, in the order they are searched; ~ is the user's own.
DIRS = [r"C:\Windows\Fonts", "/System/Library/Fonts", "/System/Library/Fonts/Supplemental", "/Library/Fonts", "~/Library/Fonts", "/Network/Library/Fonts", "/usr/share/fonts", "/usr/local/share/fonts", "~/.fonts", "~/.local/share/fonts"]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FONTS)], "ord int, name string, file string, face int")


def preferred(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PREFERRED)), "pref_ord int, keyword string")


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DIRS)), "dir_ord int, dir string")
