"""Text geolocation at scale on Spark: matching, ranking, fusion, verification and evaluation as DataFrame operators."""
