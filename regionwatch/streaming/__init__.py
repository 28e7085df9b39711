"""regionwatch.streaming"""
