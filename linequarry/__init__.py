"""Line-corpus analytics on Spark: matching, review, events, layout and statistics as DataFrame plans."""
