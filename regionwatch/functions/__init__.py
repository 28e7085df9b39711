"""regionwatch.functions"""
