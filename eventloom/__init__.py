"""Spark-native analytics for multichannel series and the labelled events found in them."""
