"""recengine.streaming"""
