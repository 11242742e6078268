"""planweave.streaming"""
